"""The 11 CSV upload contracts and the key / foreign-key / rule tables of the 16 record tables.

A contract maps CSV headers to canonical typed columns. ``apply_contract``
(operators/contract.py) turns one contract into a single ``select`` of
built-in expressions plus an array of reject reasons.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    name: str                      # canonical column
    headers: tuple[str, ...]       # header aliases, first non-empty wins
    kind: str = "string"           # string|int|decimal(p,s)|bool|date|time|timestamp|list|lookup
    required: bool = False         # '' -> reject
    max_len: int | None = None     # VARCHAR(n)
    domain: tuple[str, ...] | None = None
    default: object = None         # applied when the value is missing
    lookup: str | None = None      # for kind == 'lookup': dimension name
    pick_default: bool = False     # default joins the alias pick (before trim), as the terms route does


@dataclass(frozen=True)
class Contract:
    name: str
    table: str
    keys: tuple[str, ...]
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)


# Domains declared by the record schema's CHECK constraints.
USER_ROLES = ("admin", "faculty", "student")
TERM_STATUS = ("upcoming", "active", "completed")
STUDENT_STATUS = ("active", "inactive", "graduated", "dropped")
COURSE_TYPES = ("theory", "lab", "project")
ENROLLMENT_STATUS = ("enrolled", "dropped", "completed")
TIMETABLE_STATUS = ("draft", "active", "archived")
ENTRY_TYPES = ("lecture", "lab", "tutorial", "break")
SLOT_TYPES = ("lecture", "lab", "break", "lunch")
AUDIT_ACTIONS = ("INSERT", "UPDATE", "DELETE")

# The 11 upload contracts (header -> column), in load order
# (parents before children).
CONTRACTS: dict[str, Contract] = {c.name: c for c in [
    Contract("departments", "departments", ("code",), (
        Field("code", ("Code", "code"), max_len=10),
        Field("name", ("Name", "name", "Department"), required=True, max_len=255),
        Field("description", ("Description", "description")),
        Field("hod_email", ("Head of Department Email", "hod_email")),
    )),
    Contract("academic_terms", "academic_terms", ("name",), (
        Field("name", ("Name", "name"), required=True, max_len=50),
        Field("start_date", ("Start Date", "start_date"), kind="date", required=True),
        Field("end_date", ("End Date", "end_date"), kind="date", required=True),
        Field("academic_year", ("Academic Year", "academic_year"), required=True, max_len=10),
        Field("status", ("Status", "status"), max_len=20, domain=TERM_STATUS, default="upcoming",
              pick_default=True),
    )),
    Contract("programs", "programs", ("code",), (
        Field("code", ("Code",), required=True, max_len=20),
        Field("name", ("Name",), required=True, max_len=255),
        Field("department_id", ("Department Code",), kind="lookup", lookup="departments"),
        Field("duration_years", ("Duration Years",), kind="int", default=4),
        Field("total_semesters", ("Total Semesters",), kind="int", default=8),
        Field("description", ("Description",)),
    )),
    Contract("time_slots", "time_slots", ("slot_name",), (
        Field("slot_name", ("Slot Name",), required=True, max_len=50),
        Field("start_sec", ("Start Time",), kind="time", required=True),
        Field("end_sec", ("End Time",), kind="time", required=True),
        Field("duration_minutes", ("Duration Minutes",), kind="int", required=True),
        Field("slot_type", ("Slot Type",), max_len=20, domain=SLOT_TYPES, default="lecture"),
        Field("is_active", ("Is Active",), kind="bool", default=True),
    )),
    Contract("classrooms", "classrooms", ("room_code",), (
        Field("room_code", ("Room Code",), required=True, max_len=50),
        Field("building", ("Building",), max_len=100),
        Field("floor", ("Floor",), kind="int"),
        Field("capacity", ("Capacity",), kind="int", required=True),
        Field("type", ("Type",), required=True, max_len=50),
        Field("equipment", ("Equipment",), kind="list"),
        Field("is_available", ("Is Available",), kind="bool", default=True),
    )),
    Contract("students", "students", ("student_id",), (
        Field("name", ("Name",)),
        Field("student_id", ("Student ID",), required=True, max_len=50),
        Field("email", ("Email",), max_len=255),
        Field("program_id", ("Program Code",), kind="lookup", lookup="programs"),
        Field("batch_id", ("Batch Name",), kind="lookup", lookup="batches"),
        Field("enrollment_year", ("Enrollment Year",), kind="int", required=True),
        Field("current_semester", ("Current Semester",), kind="int", default=1),
        Field("phone", ("Phone",), max_len=20),
        Field("guardian_name", ("Guardian Name",), max_len=255),
        Field("guardian_phone", ("Guardian Phone",), max_len=20),
        Field("address", ("Address",)),
        Field("status", ("Status",), max_len=20, domain=STUDENT_STATUS, default="active"),
    )),
    Contract("faculty", "faculty", ("employee_id",), (
        Field("name", ("Name",)),
        Field("employee_id", ("Employee ID",), required=True, max_len=50),
        Field("email", ("Email",), max_len=255),
        Field("department_id", ("Department Code",), kind="lookup", lookup="departments"),
        Field("designation", ("Designation",), max_len=100),
        Field("phone", ("Phone",), max_len=20),
        Field("qualification", ("Qualification",)),
        Field("experience_years", ("Experience Years",), kind="int"),
        Field("specialization", ("Specialization",), kind="list"),
        Field("working_hours_per_week", ("Working Hours Per Week",), kind="int", default=20),
        Field("time_preferences", ("Time Preferences",), kind="list"),
        Field("subjects_taught", ("Subjects Can Teach",), kind="list"),
    )),
    Contract("courses", "courses", ("course_code",), (
        Field("course_code", ("Course Code",), required=True, max_len=20),
        Field("title", ("Title",), required=True, max_len=255),
        Field("department_id", ("Department Code",), kind="lookup", lookup="departments"),
        Field("semester", ("Semester",), kind="int"),
        Field("credits", ("Credits",), kind="decimal(3,1)", default="3.0"),
        Field("hours_per_week", ("Hours Per Week",), kind="int", default=3),
        Field("course_type", ("Course Type",), max_len=20, domain=COURSE_TYPES, default="theory"),
        Field("prerequisites", ("Prerequisites",)),
        Field("is_elective", ("Is Elective",), kind="bool", default=False),
        Field("description", ("Description",)),
    )),
    Contract("course_prerequisites", "course_prerequisites", ("course_id", "prerequisite_id"), (
        Field("course_id", ("Course Code",), kind="lookup", lookup="courses"),
        Field("prerequisite_id", ("Prerequisite Course Code",), kind="lookup", lookup="courses"),
        Field("is_mandatory", ("Is Mandatory",), kind="bool", default=True),
    )),
    Contract("student_enrollments", "enrollments", ("student_id", "course_id", "academic_year"), (
        Field("student_id", ("Student ID",), kind="lookup", lookup="students"),
        Field("course_id", ("Course Code",), kind="lookup", lookup="courses"),
        Field("academic_year", ("Academic Year",), required=True, max_len=10),
        Field("semester", ("Semester",), kind="int", required=True),
        Field("enrollment_date", ("Enrollment Date",), kind="timestamp"),
        Field("status", ("Status",), max_len=20, domain=ENROLLMENT_STATUS, default="enrolled"),
    )),
    Contract("course_assignments", "course_assignments",
             ("course_id", "faculty_id", "semester", "academic_year", "section"), (
        Field("course_id", ("Course Code",), kind="lookup", lookup="courses"),
        Field("faculty_id", ("Faculty Employee ID",), kind="lookup", lookup="faculty"),
        Field("academic_year", ("Academic Year",), required=True, max_len=10),
        Field("semester", ("Semester",), kind="int", required=True),
        Field("section", ("Section",), max_len=10, default="A"),
        Field("max_students", ("Max Students",), kind="int", default=60),
    )),
]}

# The natural key each lookup resolves against (dimension -> code column).
LOOKUP_CODES = {
    "departments": "code", "programs": "code", "batches": "name", "courses": "course_code",
    "students": "student_id", "faculty": "employee_id",
}

# Foreign keys of the record schema, (child, column, parent, on_delete).
FOREIGN_KEYS = (
    ("departments", "head_of_department", "users", "restrict"),
    ("programs", "department_id", "departments", "restrict"),
    ("faculty", "user_id", "users", "cascade"),
    ("faculty", "department_id", "departments", "restrict"),
    ("batches", "program_id", "programs", "restrict"),
    ("students", "user_id", "users", "cascade"),
    ("students", "program_id", "programs", "restrict"),
    ("students", "batch_id", "batches", "restrict"),
    ("courses", "department_id", "departments", "restrict"),
    ("course_prerequisites", "course_id", "courses", "cascade"),
    ("course_prerequisites", "prerequisite_id", "courses", "cascade"),
    ("course_assignments", "course_id", "courses", "restrict"),
    ("course_assignments", "faculty_id", "faculty", "restrict"),
    ("enrollments", "student_id", "students", "restrict"),
    ("enrollments", "course_id", "courses", "restrict"),
    ("timetables", "program_id", "programs", "restrict"),
    ("timetables", "batch_id", "batches", "restrict"),
    ("timetables", "created_by", "users", "restrict"),
    ("timetable_entries", "timetable_id", "timetables", "cascade"),
    ("timetable_entries", "course_id", "courses", "restrict"),
    ("timetable_entries", "faculty_id", "faculty", "restrict"),
    ("timetable_entries", "classroom_id", "classrooms", "restrict"),
    ("audit_logs", "changed_by", "users", "restrict"),
)

# UNIQUE keys of the record schema.
UNIQUE_KEYS = {
    "users": ("email",), "departments": ("code",), "academic_terms": ("name",), "programs": ("code",),
    "faculty": ("employee_id",), "batches": ("name",), "students": ("student_id",),
    "classrooms": ("room_code",), "courses": ("course_code",),
    "course_prerequisites": ("course_id", "prerequisite_id"),
    "course_assignments": ("course_id", "faculty_id", "semester", "academic_year", "section"),
    "enrollments": ("student_id", "course_id", "academic_year"),
}

# Tables whose updated_at is touched on update (not batches).
TOUCHED_TABLES = ("users", "departments", "programs", "students", "faculty", "courses", "classrooms",
                  "academic_terms")

# Soft-deleted tables (deleted_at IS NULL means live).
SOFT_DELETE_TABLES = ("students", "faculty")

# Tables reported by the setup check, in its order.
SETUP_CHECK_TABLES = ("users", "departments", "programs", "academic_terms", "time_slots", "students",
                      "faculty", "courses", "classrooms")
