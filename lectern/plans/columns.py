"""Printed columns of the current reports, in order.

The labels are fixed values: files and screens show exactly these texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRO_USUARIOS = {
    "idnumber": "Código de grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "level": "Nivel del grupo/ficha",
    "modality": "Modalidad",
    "course_state": "Estado del grupo/ficha",
    "program_code_label": "Código Programa de Formación",
    "version_label": "Versión Programa de Formación",
    "program_title": "Programa de formación",
    "start_text": "Fecha de inicio de grupo/ficha",
    "end_text": "Fecha fin de grupo/ficha",
    "region": "Regional",
    "center": "Centro de Formación",
    "role_text": "Rol de usuario",
    "document_type": "Tipo de Documento",
    "document": "Documento",
    "person": "Nombres y apellidos",
    "first_access_text": "Fecha de acceso al grupo/ficha",
    "last_lms_access": "Fecha de último acceso al LMS",
    "access_days": "Total días que Ingresó",
    "accesses": "Total ingresos al grupo/ficha",
    "enrolment_state": "Estado matrícula LMS",
}

INGRESOS_SISTEMA = {
    "role_text": "Rol de usuario",
    "system": "Sistema operativo",
    "browser": "Navegador web",
    "country": "País registrado en perfil",
    "city": "Ciudad registrada en perfil",
    "ip": "IP de ingreso",
    "logins": "Total de ingresos",
    "users": "Usuarios únicos",
}

MATRICULAS_LMS = {
    "idnumber": "Código de grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "level": "Nivel del grupo/ficha",
    "modality": "Modalidad",
    "course_state": "Estado del grupo/ficha",
    "program_code_label": "Código del Programa",
    "version_label": "Versión del Programa",
    "program_title": "Programa de formación",
    "region": "Regional",
    "center": "Centro de Formación",
    "role_text": "Rol de usuario",
    "document_type": "Tipo de Documento",
    "document": "Documento",
    "person": "Nombres y apellidos",
    "enrolment_state": "Estado matrícula LMS",
    "method_state": "Estado método de matrícula",
    "user_state": "Estado del Usuario LMS",
    "start_text": "Fecha inicio grupo/ficha",
    "end_text": "Fecha fin grupo/ficha",
    "enrolled_text": "Fecha Enrolamiento",
    "left_text": "Fecha Desenrolamiento",
}

USUARIOS_AMBIENTE = {
    "environment": "Ambiente",
    "role_text": "Rol de usuario",
    "document_type": "Tipo de Identificación",
    "document": "Identificación",
    "person": "Nombres y apellidos",
    "user_state": "Estado del Usuario LMS",
    "auth": "Método de autenticación",
    "auth_origin": "Origen de Creación del Usuario",
    "created_text": "Fecha Creación del Usuario en el ambiente",
    "last_lms_access": "Fecha del último acceso",
    "creator": "Usuario Creador",
}

FICHAS_PROGRAMAS = {
    "program_code_label": "Código programa",
    "version_label": "Versión del programa",
    "program_title": "Nombre de programa",
    "program_state": "Estado del Programa",
    "idnumber": "Código grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "created_text": "Fecha de creación del grupo",
    "level": "Nivel del grupo/ficha",
    "modality": "Modalidad",
    "start_text": "Fecha de inicio de grupo",
    "end_text": "Fecha fin de grupo",
    "external_state": "Estado Grupo/ficha SOFIA Plus",
    "course_state": "Estado Grupo/ficha LMS",
    "region": "Regional",
    "center": "Centro de Formación",
    "teachers_active": "Cantidad de Instructores Activos",
    "students_active": "Cantidad de Aprendices Activos",
    "teachers_inactive": "Cantidad de Instructores Inactivos",
    "students_inactive": "Cantidad de Aprendices Inactivos",
}

TRAFICO_DIARIO = {
    "environment": "Ambiente",
    "origin": "Origen de Datos",
    "range": "Rango de Consulta",
    "year": "Año",
    "month": "Mes",
    "day_of_month": "Día",
    "period_text": "Periodo",
    "users": "Cantidad de Usuarios Únicos",
}

USO_HERRAMIENTAS = {
    "program_code_label": "Código del programa",
    "version_label": "Versión programa",
    "program_title": "Nombre del programa de formación",
    "level": "Nivel de formación",
    "modality": "Modalidad",
    "idnumber": "Código de grupo/ficha",
    "fullname": "Nombre grupo/ficha",
    "start_text": "Fecha de inicio del grupo/ficha",
    "end_text": "Fecha fin del grupo/ficha",
    "course_state": "Estado grupo/ficha",
    "origin": "Origen de Datos",
    "region": "Regional",
    "center": "Centro de Formación",
    "wiki_users": "Número usuarios con participación en wikis",
    "wiki_items": "Cantidad de wikis",
    "encuesta_users": "Número usuarios con participación en encuestas",
    "encuesta_items": "Cantidad de encuestas",
    "evaluacion_users": "Número usuarios con participación en Evaluaciones",
    "evaluacion_items": "Cantidad de Evaluaciones",
    "evidencia_users": "Número usuarios con participación en evidencias",
    "evidencia_items": "Cantidad de evidencias",
    "blog_users": "Número usuarios con participación en blogs",
    "blog_items": "Cantidad de blogs",
    "anuncio_users": "Número usuarios con participación en anuncios",
    "anuncio_items": "Cantidad de anuncios",
    "foro_users": "Número usuarios con participación en foros temáticos",
    "foro_items": "Cantidad de foros temáticos",
    "scorm_users": "Número usuarios con participación en scorm",
    "scorm_items": "Cantidad de scorm",
    "sesion_users": "Número de usuarios con participación sesiones en línea",
    "sesion_items": "Cantidad de sesiones en línea",
    "chat_users": "Número de usuarios con participación en chats",
    "chat_items": "Cantidad de chats",
    "notification_users": "Número de usuarios con participación en notificaciones",
    "notification_items": "Cantidad de notificaciones",
}

_PLACE_AND_PROGRAM = {
    "region": "Regional",
    "center_code_label": "Código del centro",
    "center": "Nombre del centro",
    "program_code_label": "Código del programa",
    "version_label": "Versión programa",
    "program_title": "Nombre del programa de formación",
    "level": "Nivel de formación",
    "program_state": "Estado del Programa",
}

_PERSON = {
    "document_type": "Tipo de Identificación",
    "document": "Identificación",
    "person": "Nombres y apellidos",
    "group_state": "Estado del usuario en el grupo",
}

PARTICIPACION_HERRAMIENTAS = {
    **_PLACE_AND_PROGRAM,
    "idnumber": "Código del grupo",
    "start_text": "Fecha de inicio del grupo",
    "end_text": "Fecha fin del grupo",
    **_PERSON,
    "course_state": "Estado grupo/ficha LMS",
    "accesses": "Número de ingresos del usuario al AVA",
    "last_access_text": "Fecha del último ingreso al AVA",
    "wikis": "Número de participaciones del usuario en wikis",
    "surveys": "Número de encuestas realizadas por el usuario",
    "forums": "Número de foros creados por el usuario",
    "replies": "Número de comentarios del usuario en foros",
    "quizzes": "Número de pruebas de conocimiento realizadas por el usuario",
    "blogs": "Número de blogs creados por el usuario",
    "assignments": "Número de evidencias entregadas por el usuario",
    "scorm": "Número de participaciones del usuario en SCORM",
    "sessions": "Número de sesiones en línea con participación del usuario",
    "chats": "Número de chats con participación del usuario",
    "announcements": "Número de anuncios con participación del usuario",
}

TIEMPO_PERMANENCIA = {
    **_PLACE_AND_PROGRAM,
    "idnumber": "Código del grupo",
    "start_text": "Fecha de inicio del grupo",
    "end_text": "Fecha fin del grupo",
    **_PERSON,
    "course_state": "Estado grupo",
    "accesses": "Número de ingresos del usuario a grupo/ficha",
    "last_access_text": "Fecha del último ingreso grupo/ficha",
    "pct_wiki": "Porcentaje de tiempo en wikis con participaciones del usuario",
    "pct_surveys": "Porcentaje de tiempo en encuestas realizadas por el usuario",
    "pct_forums": "Porcentaje de tiempo en foros",
    "pct_quizzes": "Porcentaje de tiempo en Pruebas de Conocimientos",
    "pct_blogs": "Porcentaje de tiempo en blogs",
    "pct_assignments": "Porcentaje de tiempo en evidencias entregadas",
    "pct_scorm": "Porcentaje de tiempo en scorm",
    "pct_sessions": "Porcentaje de tiempo en sesiones en línea",
    "pct_chats": "Porcentaje de tiempo en chats",
    "pct_attendance": "Porcentaje de tiempo en lista de asistencia",
    "minutes": "Total tiempo en grupo/ficha",
}

SESIONES_ONLINE = {
    **_PLACE_AND_PROGRAM,
    "idnumber": "Código de grupo/ficha",
    "start_text": "Fecha de inicio del grupo/ficha",
    "end_text": "Fecha fin del grupo",
    "course_state": "Estado grupo",
    "joins": "Cantidad de ingresos a la sesión",
    "meetingid": "Código de la sesión",
    "session_name": "Nombre de la Sesión",
    "opening_text": "Fecha de inicio de la sesión",
    "closing_text": "Fecha Fin de la Sesión",
    "started_text": "Sesión Iniciada Sí / No",
    "recorded_text": "Grabación Sí / No",
}


def printed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Keep the printed columns, under their labels."""
    return df.select(*[F.col(name).alias(label) for name, label in columns.items()])
