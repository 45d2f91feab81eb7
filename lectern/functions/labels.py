"""Labels derived from codes and flags. The label texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDEFINED = "No definido"
UNSET_DATE = "No definida"
NOT_AVAILABLE = "No disponible (SOFIA Plus)"
NOT_IN_LOG = "No disponible en Moodle estándar"
INTEGRATION = "Integración"
MANUAL = "Manual"
EXTERNAL = "Integración / Externo"


def course_state(visible: Column, start: Column, end: Column, now: int) -> Column:
    return (
        F.when(visible == 0, "Oculto")
        .when(start > now, "No iniciado")
        .when((end > 0) & (end < now), "Finalizado")
        .otherwise("En ejecución")
    )


def level(letter: Column) -> Column:
    return F.when(letter.isin("V", "A", "P", "PI"), "Formación titulada").otherwise(UNDEFINED)


def modality_or_null(letter: Column) -> Column:
    return (
        F.when(letter == "V", "Titulada virtual")
        .when(letter == "A", "Titulada a distancia")
        .when(letter.isin("P", "PI"), "Titulada presencial")
    )


def modality(letter: Column) -> Column:
    return F.coalesce(modality_or_null(letter), F.lit(UNDEFINED))


def user_state(deleted: Column, suspended: Column) -> Column:
    return F.when(deleted == 1, "Eliminado").when(suspended == 1, "Suspendido").otherwise("Activo")


def auth_origin(auth: Column) -> Column:
    return F.when(auth == "manual", MANUAL).otherwise(EXTERNAL)


def origin(integrated: Column) -> Column:
    return F.when(integrated, INTEGRATION).otherwise(MANUAL)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Sí").otherwise("No")


def tool_class(module: Column, forum_type: Column) -> Column:
    """Reporting class of an activity module."""
    forum = F.when(forum_type == "blog", "blog").when(forum_type == "news", "anuncio").otherwise("foro")
    return (
        F.when(module == "forum", forum)
        .when(module.isin("feedback", "survey"), "encuesta")
        .when(module == "quiz", "evaluacion")
        .when(module == "assign", "evidencia")
        .when(module == "bigbluebuttonbn", "sesion")
        .otherwise(module)
    )


def time_tool_class(module: Column, forum_type: Column) -> Column:
    """Class used for time on task: raw module names, events outside modules kept."""
    forum = F.when(forum_type == "blog", "blog").when(forum_type == "news", "anuncio").otherwise("foro")
    return (
        F.when(module.isNull(), "curso")
        .when(module == "forum", forum)
        .when(module.isin("attendance", "attendanceregister"), "asistencia")
        .otherwise(module)
    )
