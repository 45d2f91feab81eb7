"""Columns of the LMS tables that the reports read, with their types.

Times are epoch seconds (``bigint``) where 0 and NULL both mean "not set".
"""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()

# Table and column names.
COLUMNS: dict[str, tuple[tuple[str, T.DataType], ...]] = {
    "mdl_course": (
        ("id", LONG), ("idnumber", TEXT), ("shortname", TEXT), ("fullname", TEXT), ("category", LONG),
        ("visible", INT), ("startdate", LONG), ("enddate", LONG), ("timecreated", LONG),
    ),
    "mdl_course_categories": (
        ("id", LONG), ("name", TEXT), ("sortorder", LONG),
    ),
    "mdl_course_modules": (
        ("id", LONG), ("course", LONG), ("module", LONG), ("instance", LONG), ("deletioninprogress", INT),
    ),
    "mdl_modules": (
        ("id", LONG), ("name", TEXT),
    ),
    "mdl_user": (
        ("id", LONG), ("username", TEXT), ("idnumber", TEXT), ("firstname", TEXT), ("lastname", TEXT),
        ("email", TEXT), ("auth", TEXT), ("country", TEXT), ("city", TEXT), ("deleted", INT),
        ("suspended", INT), ("timecreated", LONG), ("lastaccess", LONG),
    ),
    "mdl_user_info_field": (
        ("id", LONG), ("shortname", TEXT), ("name", TEXT), ("datatype", TEXT),
    ),
    "mdl_user_info_data": (
        ("id", LONG), ("userid", LONG), ("fieldid", LONG), ("data", TEXT),
    ),
    "mdl_enrol": (
        ("id", LONG), ("courseid", LONG), ("status", INT),
    ),
    "mdl_user_enrolments": (
        ("id", LONG), ("enrolid", LONG), ("userid", LONG), ("status", INT), ("timestart", LONG),
        ("timeend", LONG), ("timecreated", LONG), ("timemodified", LONG),
    ),
    "mdl_role": (
        ("id", LONG), ("shortname", TEXT), ("name", TEXT), ("sortorder", LONG),
    ),
    "mdl_role_assignments": (
        ("id", LONG), ("userid", LONG), ("contextid", LONG), ("roleid", LONG),
    ),
    "mdl_context": (
        ("id", LONG), ("contextlevel", INT), ("instanceid", LONG),
    ),
    "mdl_logstore_standard_log": (
        ("id", LONG), ("userid", LONG), ("courseid", LONG), ("contextlevel", INT), ("contextinstanceid", LONG),
        ("eventname", TEXT), ("component", TEXT), ("action", TEXT), ("target", TEXT), ("objecttable", TEXT),
        ("objectid", LONG), ("ip", TEXT), ("origin", TEXT), ("timecreated", LONG),
    ),
    "mdl_forum": (
        ("id", LONG), ("course", LONG), ("name", TEXT), ("type", TEXT),
    ),
    "mdl_forum_discussions": (
        ("id", LONG), ("forum", LONG), ("userid", LONG), ("timemodified", LONG),
    ),
    "mdl_forum_posts": (
        ("id", LONG), ("discussion", LONG), ("userid", LONG), ("parent", LONG), ("created", LONG),
    ),
    "mdl_quiz": (
        ("id", LONG), ("course", LONG),
    ),
    "mdl_quiz_attempts": (
        ("id", LONG), ("quiz", LONG), ("userid", LONG), ("state", TEXT), ("timefinish", LONG),
    ),
    "mdl_assign": (
        ("id", LONG), ("course", LONG),
    ),
    "mdl_assign_submission": (
        ("id", LONG), ("assignment", LONG), ("userid", LONG), ("status", TEXT), ("timemodified", LONG),
        ("timecreated", LONG),
    ),
    "mdl_feedback": (
        ("id", LONG), ("course", LONG),
    ),
    "mdl_feedback_completed": (
        ("id", LONG), ("feedback", LONG), ("userid", LONG), ("timemodified", LONG),
    ),
    "mdl_survey": (
        ("id", LONG), ("course", LONG),
    ),
    "mdl_survey_answers": (
        ("id", LONG), ("survey", LONG), ("userid", LONG), ("time", LONG),
    ),
    "mdl_chat": (
        ("id", LONG), ("course", LONG),
    ),
    "mdl_chat_messages": (
        ("id", LONG), ("chatid", LONG), ("userid", LONG), ("timestamp", LONG),
    ),
    "mdl_wiki": (
        ("id", LONG), ("course", LONG),
    ),
    "mdl_bigbluebuttonbn": (
        ("id", LONG), ("course", LONG), ("name", TEXT), ("meetingid", TEXT), ("openingtime", LONG),
        ("closingtime", LONG), ("record", INT),
    ),
    "mdl_bigbluebuttonbn_logs": (
        ("id", LONG), ("bigbluebuttonbnid", LONG), ("userid", LONG), ("log", TEXT), ("timecreated", LONG),
    ),
    "mdl_bigbluebuttonbn_recordings": (
        ("id", LONG), ("bigbluebuttonbnid", LONG), ("status", INT),
    ),
    "regionales": (
        ("rgn_id", LONG), ("nombre", TEXT),
    ),
    "centros": (
        ("sed_id", LONG), ("nombre", TEXT),
    ),
    "seeds": (
        ("code", LONG), ("program_type", TEXT), ("education_level", TEXT), ("prog_name", TEXT),
        ("design_version", INT), ("seed_version", INT), ("current_version", INT), ("modality", TEXT),
        ("status_seed", TEXT), ("lms_id", LONG),
    ),
    "seeds_induction": (
        ("code", LONG), ("program_type", TEXT), ("education_level", TEXT), ("prog_name", TEXT),
        ("design_version", INT), ("seed_version", INT), ("current_version", INT), ("modality", TEXT),
        ("status_seed", TEXT), ("lms_id", LONG),
    ),
    "solicitudes": (
        ("id", LONG), ("reporte_codigo", TEXT), ("usuario_email", TEXT), ("estado", TEXT), ("formato", TEXT),
        ("archivo_ruta", TEXT), ("filas_procesadas", LONG), ("fecha_solicitud", LONG), ("fecha_fin", LONG),
        ("filtros", TEXT),
    ),
}

SCHEMAS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(column, kind) for column, kind in columns]) for name, columns in COLUMNS.items()
}

# The same log with its clock compressed 300 times; used to test time on task.
SCHEMAS["mdl_logstore_dense"] = SCHEMAS["mdl_logstore_standard_log"]
