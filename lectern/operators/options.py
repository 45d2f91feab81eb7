"""Values offered by the report filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions import text as X
from lectern.operators.courses import real_courses
from lectern.sources import LmsTables

# Roles never offered, and names of roles stored without one.
HIDDEN_ROLES = ("guest", "user", "frontpage")
ROLE_NAMES = {
    "manager": "Gestor",
    "coursecreator": "Creador de cursos",
    "editingteacher": "Instructor editor",
    "teacher": "Instructor",
    "student": "Aprendiz",
}
ALL = "Todas"
FILTERS = ("rol_usuario", "modalidad", "nivel", "id_categoria")
LEVELS = ("Formación titulada", "No definido")


def _listed(df: DataFrame, name: str, value: Column, label: Column, *order: Column) -> DataFrame:
    """Option rows; ``order`` is (sort number, id, text) after the "all" entry."""
    number, ident, text = order
    return df.select(
        F.lit(name).alias("filter"),
        number.cast("bigint").alias("o1"),
        ident.cast("bigint").alias("o2"),
        text.cast("string").alias("o3"),
        value.alias("value"),
        label.alias("label"),
    )


def filter_options(t: LmsTables) -> DataFrame:
    """(filter, value, label) of the role, modality, level and category lists."""
    zero, none = F.lit(0), F.lit("")
    short = F.col("shortname")
    known = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    role_label = F.coalesce(F.nullif(F.trim("name"), none), F.try_element_at(known, short), short)
    roles = _listed(
        t.role.filter(~short.isin(*HIDDEN_ROLES)),
        "rol_usuario", short, role_label, F.col("sortorder"), F.col("id"), none,
    )
    kinds = (
        real_courses(t)
        .select(L.modality_or_null(X.modality_letter(short)).alias("kind"))
        .filter(F.col("kind").isNotNull())
        .distinct()
    )
    kind = F.col("kind")
    modalities = _listed(kinds, "modalidad", kind, kind, zero, zero, kind)
    categories = _listed(
        t.course_categories, "id_categoria", F.col("id").cast("string"), F.col("name"),
        F.col("sortorder"), F.col("id"), none,
    )
    fixed = [(name, -1, 0, "", "", ALL) for name in FILTERS]
    fixed += [("nivel", 0, i, "", level, level) for i, level in enumerate(LEVELS)]
    constant = t.spark.createDataFrame(
        fixed, "filter string, o1 bigint, o2 bigint, o3 string, value string, label string"
    )
    options = constant.unionByName(roles).unionByName(modalities).unionByName(categories)
    return options.orderBy("filter", "o1", "o2", "o3").select("filter", "value", "label")


def profile_fields(t: LmsTables) -> DataFrame:
    return t.user_info_field.select("id", "shortname", "name", "datatype").orderBy("shortname")
