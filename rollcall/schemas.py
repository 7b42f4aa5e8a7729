"""Programme tables: keys, required columns, text widths and references.

Parquet enforces none of these; ``operators.constraints`` checks them as
queries.  Names: participants (registrations), bookings (form responses),
team_building, submissions (blog/project), verification, weekly (weekly
challenge entries), labs (hands-on lab proofs).
"""

from __future__ import annotations

# Primary keys per table.
PRIMARY_KEYS = {
    "participants": ["email"],
    "bookings": ["email", "form_name"],
    "team_building": ["workshop_name", "email"],
    "submissions": ["workshop_name", "email"],
    "verification": ["workshop_name", "email"],
    "weekly": ["week_number", "email"],
    "labs": ["workshop_name", "email"],
}

# NOT NULL columns per table (timestamps with defaults included).
NOT_NULL = {
    "participants": ["email", "name", "registration_date_time"],
    "bookings": ["email", "form_name", "name"],
    "team_building": ["workshop_name", "email", "name"],
    "submissions": ["workshop_name", "email", "name"],
    "verification": ["workshop_name", "email", "name"],
    "weekly": ["week_number", "email"],
    "labs": ["workshop_name", "email", "name"],
}

# Text widths (VARCHAR(n)) per table and column.
WIDTHS = {
    "participants": {"email": 255, "name": 255, "phone_number": 20, "gender": 20, "country": 100, "state": 100,
                     "city": 100, "designation": 255, "class_stream": 255, "occupation": 255, "linkedin": 500},
    "bookings": {"email": 255, "form_name": 255, "name": 255, "time_slot_range": 255},
    "team_building": {"workshop_name": 255, "email": 255, "name": 255, "workshop_link": 500, "team_id": 255},
    "submissions": {"workshop_name": 255, "email": 255, "name": 255, "project_link": 500, "team_id": 255},
    "verification": {"workshop_name": 255, "email": 255, "name": 255, "project_ss": 500, "blog": 500,
                     "team_id": 255},
    "weekly": {"email": 255, "validation_reason": 255, "github_validation_reason": 255},
    "labs": {"workshop_name": 255, "email": 255, "name": 255, "problem_statement": 500, "proof_link": 500,
             "assigned_to": 255, "blog_submission": 500},
}

# Every child table references participants by e-mail, cascading deletes and
# key updates.
CHILD_TABLES = ["bookings", "team_building", "submissions", "verification", "weekly", "labs"]
FOREIGN_KEY = "email"
