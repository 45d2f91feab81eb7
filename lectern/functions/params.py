"""Report parameters: which exist, which are set, and their normal form.

Optional filters are decided here, before planning: a filter that is not set
adds nothing to the plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

# Report titles, the parameters of each report in printed order,
# and the labels of the parameters in file headings.
TITLES: dict[str, str] = {
    "registro_usuarios": "Registro de Usuarios",
    "ingresos_sistema": "Ingresos por Navegador, Ubicación y Sistema",
    "matriculas_lms": "Matrículas LMS",
    "usuarios_ambiente": "Usuarios por Ambiente",
    "fichas_programas": "Grupos y Programas de Formación",
    "trafico_diario": "Tráfico Diario de Usuarios",
    "uso_herramientas": "Herramientas LMS",
    "participacion_herramientas": "Participación por Herramientas",
    "tiempo_permanencia": "Tiempo de Permanencia por Herramientas",
    "sesiones_online": "Sesiones en Línea / VideoConferencia",
}

DECLARED: dict[str, tuple[str, ...]] = {
    "registro_usuarios": (
        "nivel", "modalidad", "regional", "centro_formacion", "estado_grupo", "rol_usuario", "estado_aprendiz",
        "origen_datos", "codigo_ficha", "nombre_ficha", "identificacion", "nombres_apellidos", "fecha_inicio",
        "fecha_fin", "hora",
    ),
    "ingresos_sistema": (
        "mes", "semana", "hora", "fecha_desde", "fecha_hasta", "pais", "ciudad",
    ),
    "matriculas_lms": (
        "nivel", "modalidad", "regional", "origen_datos", "estado_grupo", "rol_usuario", "centro_formacion",
        "fecha_desde", "fecha_hasta", "codigo_ficha", "nombre_ficha", "fecha_inicio", "fecha_fin",
    ),
    "usuarios_ambiente": (
        "mes", "anio", "origen_datos", "fecha_desde", "fecha_hasta",
    ),
    "fichas_programas": (
        "nivel", "modalidad", "regional", "centro_formacion", "estado_grupo_sofia", "rol_usuario",
        "estado_aprendiz", "origen_datos", "codigo_programa", "nombre_programa", "hora_creacion", "fecha_desde",
        "fecha_hasta", "codigo_ficha", "nombre_ficha", "hora_grupo", "fecha_inicio", "fecha_fin",
    ),
    "trafico_diario": (
        "fecha_desde", "fecha_hasta", "origen_datos", "rango_consulta",
    ),
    "uso_herramientas": (
        "nivel", "modalidad", "regional", "centro_formacion", "estado_grupo", "rol_usuario", "origen_datos",
        "codigo_programa", "nombre_programa", "hora_consulta", "fecha_desde", "fecha_hasta", "codigo_ficha",
        "nombre_ficha", "hora_grupo", "fecha_inicio", "fecha_fin",
    ),
    "participacion_herramientas": (
        "nivel", "modalidad", "regional", "centro_formacion", "estado_grupo", "rol_usuario", "estado_usuario",
        "estado_aprendiz", "codigo_programa", "nombre_programa", "origen_datos", "identificacion",
        "nombres_apellidos", "fecha_desde", "fecha_hasta", "codigo_ficha", "nombre_ficha", "fecha_inicio",
        "fecha_fin",
    ),
    "tiempo_permanencia": (
        "nivel", "modalidad", "regional", "centro_formacion", "estado_grupo", "rol_usuario", "estado_usuario",
        "estado_aprendiz", "codigo_programa", "nombre_programa", "origen_datos", "identificacion",
        "nombres_apellidos", "fecha_desde", "fecha_hasta", "codigo_ficha", "nombre_ficha", "fecha_inicio",
        "fecha_fin",
    ),
    "sesiones_online": (
        "nivel", "modalidad", "regional", "centro_formacion", "estado_grupo", "rol_usuario", "origen_datos",
        "fecha_desde", "fecha_hasta", "codigo_programa", "nombre_programa", "codigo_ficha", "nombre_ficha",
        "identificacion", "nombres_apellidos", "fecha_inicio_grupo_desde", "fecha_inicio_grupo_hasta",
        "fecha_creacion_grupo_desde", "fecha_creacion_grupo_hasta",
    ),
}

LABELS: dict[str, str] = {
    "nivel": "Nivel del programa",
    "modalidad": "Modalidad",
    "regional": "Regional",
    "centro_formacion": "Centro de Formación",
    "estado_grupo": "Estado del grupo/ficha",
    "estado_grupo_sofia": "Estado grupo/ficha SOFIA Plus",
    "estado_usuario": "Estado del usuario",
    "estado_aprendiz": "Estado del aprendiz (SOFIA Plus)",
    "rol_usuario": "Rol de usuario",
    "origen_datos": "Origen de datos",
    "codigo_programa": "Código programa",
    "nombre_programa": "Nombre de programa",
    "codigo_ficha": "Código grupo/ficha",
    "nombre_ficha": "Nombre grupo/ficha en el LMS",
    "identificacion": "Identificación",
    "nombres_apellidos": "Nombres y apellidos",
    "fecha_inicio": "Fecha de inicio grupo/ficha",
    "fecha_fin": "Fecha fin grupo/ficha",
    "fecha_desde": "Rango de fecha desde",
    "fecha_hasta": "Rango de fecha hasta",
    "fecha_inicio_grupo_desde": "Rango Fecha inicio de grupo/ficha desde",
    "fecha_inicio_grupo_hasta": "Rango Fecha inicio de grupo/ficha hasta",
    "fecha_creacion_grupo_desde": "Rango Fecha creación de grupo/ficha desde",
    "fecha_creacion_grupo_hasta": "Rango Fecha creación de grupo/ficha hasta",
    "hora": "Hora",
    "hora_consulta": "Hora consulta",
    "hora_creacion": "Hora creación curso LMS",
    "hora_grupo": "Hora grupo/ficha",
    "mes": "Mes",
    "anio": "Año",
    "semana": "Semana del año",
    "pais": "País",
    "ciudad": "Ciudad",
    "rango_consulta": "Rango de Consulta",
}

_GROUP = {"codigo_ficha": "Código grupo", "nombre_ficha": "Nombre grupo en el LMS"}
_TRAINING = {
    **_GROUP,
    "nivel": "Nivel de Formación",
    "fecha_inicio": "Fecha de inicio de grupo",
    "fecha_fin": "Fecha fin de grupo",
}
OWN_LABELS: dict[str, dict[str, str]] = {
    "fichas_programas": {
        **_GROUP,
        "fecha_desde": "Rango fecha creación curso desde",
        "fecha_hasta": "Rango fecha creación curso hasta",
    },
    "participacion_herramientas": _TRAINING,
    "tiempo_permanencia": {
        **_TRAINING,
        "fecha_desde": "Rango de fecha de consulta desde",
        "fecha_hasta": "Rango de fecha de consulta hasta",
    },
    "sesiones_online": {
        **_GROUP,
        "nivel": "Nivel de Formación",
        "fecha_desde": "Rango Fecha inicio de Sesión desde",
        "fecha_hasta": "Rango Fecha inicio de Sesión hasta",
    },
}


def heading(report: str, params: Mapping[str, Any]) -> list[tuple[str, Any]]:
    """(label, value) of every parameter of a report, set or not."""
    own = OWN_LABELS.get(report, {})
    return [(own.get(name, LABELS[name]), params.get(name)) for name in DECLARED[report]]


# Spellings accepted for origin and range.
_ALL_ORIGINS = {"todas", "todos"}
_INTEGRATION_SPELLINGS = {"integración", "integracion", "sofia plus", "sofía plus"}
_RANGES = {"día": "Día", "dia": "Día", "mes": "Mes", "año": "Año", "ano": "Año"}


def blank_to_none(value: Any) -> Any:
    return None if isinstance(value, str) and not value.strip() else value


def clean(report: str, given: Mapping[str, Any] | None) -> dict[str, Any]:
    """Keep declared parameters; blank text means "not set"."""
    given = given or {}
    return {name: blank_to_none(given.get(name)) for name in DECLARED[report]}


def normal_origin(value: str | None) -> str | None:
    if value is None or value.lower() in _ALL_ORIGINS:
        return None
    if value.lower() in _INTEGRATION_SPELLINGS:
        return "Integración"
    return "Manual" if value.lower() == "manual" else value


def normal_range(value: str | None) -> str:
    return _RANGES.get((value or "Día").lower(), "Día")
