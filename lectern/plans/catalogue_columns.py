"""Printed columns of the analyst catalogue reports (fixed values)."""

from __future__ import annotations

DASHBOARD = {
    "users": "Total usuarios",
    "users_active": "Total usuarios activos",
    "teachers": "Total instructores",
    "teachers_active": "Total instructores activos",
    "students": "Total aprendices",
    "students_active": "Total aprendices activos",
    "courses": "Total grupos/fichas",
    "courses_active": "Total grupos/fichas activos",
    "users_seen": "Usuarios con ingreso",
    "assigns": "Evidencias",
    "quizzes": "Evaluaciones",
    "feedbacks": "Sondeos",
    "forums": "Foros",
    "blogs": "Blogs",
    "wikis": "Wikis",
}

REGISTRO = {
    "idnumber": "Código de grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "level": "Nivel del grupo/ficha",
    "modality": "Modalidad",
    "course_state": "Estado del grupo/ficha",
    "program_code": "Codigo Programa de Formación",
    "version": "Versión Programa de Formación",
    "program": "Programa de formación",
    "start_text": "Fecha de inicio de grupo/ficha",
    "end_text": "Fecha fin de grupo/ficha",
    "region": "Regional",
    "center": "Centro de Formación",
    "role_text": "Rol de usuario",
    "document_type": "Tipo de Documento",
    "document": "Documento",
    "person": "Nombres y apellidos",
    "first_access_text": "Fecha de acceso al grupo/ficha",
    "last_lms_access": "Fecha de ultimo acceso al LMS",
    "access_days": "Total días que Ingresó",
    "accesses": "Total ingresos al grupo/ficha",
}

INGRESOS = {
    "year": "Año",
    "month": "Mes",
    "week": "Semana del año",
    "hour": "Hora",
    "system": "Sistema operativo",
    "browser": "Navegador web",
    "country": "Pais",
    "city": "Ciudad",
    "ip": "IP",
    "origin": "Origen acceso",
    "events": "Total ingresos",
    "users": "Usuarios únicos",
}

MATRICULAS = {
    "idnumber": "Código grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "level": "Nivel del programa",
    "modality": "Modalidad",
    "region": "Regional",
    "center": "Centro de Formación",
    "program_code": "Código Programa de Formación",
    "version": "Versión Programa de Formación",
    "program": "Programa de formación",
    "start_text": "Fecha de inicio grupo/ficha",
    "end_text": "Fecha fin de grupo/ficha",
    "document": "Documento",
    "person": "Nombres y apellidos",
    "email": "Correo",
    "role_text": "Rol de usuario",
    "enrolment_state": "Estado matrícula",
    "enrolled_text": "Fecha matrícula",
    "changed_text": "Fecha actualización matrícula",
}

USUARIOS = {
    "environment": "Ambiente",
    "year": "Año",
    "month": "Mes",
    "origin": "Origen de datos",
    "users": "Total usuarios",
    "active": "Usuarios activos",
    "suspended": "Usuarios suspendidos",
    "deleted": "Usuarios eliminados",
}

FICHAS = {
    "idnumber": "Código grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "level": "Nivel del grupo/ficha",
    "modality": "Modalidad",
    "course_state": "Estado del grupo/ficha",
    "program_code": "Código Programa de Formación",
    "version": "Versión Programa de Formación",
    "program": "Programa de formación",
    "region": "Regional",
    "center": "Centro de Formación",
    "created_text": "Fecha creación curso LMS",
    "start_text": "Fecha inicio grupo/ficha",
    "end_text": "Fecha fin grupo/ficha",
    "students": "Total aprendices",
    "teachers": "Total instructores",
    "persons": "Total usuarios con rol",
}

TRAFICO = {
    "day": "Fecha",
    "origin": "Origen de datos",
    "events": "Total eventos",
    "users": "Usuarios únicos",
    "courses": "Grupos/fichas con actividad",
}

_COURSE_HEAD = {
    "idnumber": "Código grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "level": "Nivel del programa",
    "modality": "Modalidad",
    "region": "Regional",
    "center": "Centro de Formación",
    "program_code": "Código Programa de Formación",
    "program": "Programa de formación",
}

USO = {
    **_COURSE_HEAD,
    "module_name": "Herramienta LMS",
    "items": "Actividades creadas",
    "uses": "Total usos",
    "users": "Usuarios únicos",
    "first_text": "Primer uso",
    "last_text": "Último uso",
}

PARTICIPACION = {
    **_COURSE_HEAD,
    "role_text": "Rol de usuario",
    "document": "Documento",
    "person": "Nombres y apellidos",
    "accesses": "Ingresos",
    "blogs": "Blogs",
    "quizzes": "Evaluaciones",
    "assignments": "Evidencias",
    "discussions": "Foros discusiones",
    "replies": "Foros comentarios",
    "surveys": "Sondeos",
    "wikis": "Wikis",
    "scorm": "SCORM",
    "total": "Total participación herramientas",
}

TIEMPO = {
    **_COURSE_HEAD,
    "document": "Documento",
    "person": "Nombres y apellidos",
    "tool": "Herramienta LMS",
    "minutes": "Minutos estimados",
    "hours": "Horas estimadas",
    "share": "Porcentaje tiempo usuario curso",
}

SESIONES_LOG = {
    "idnumber": "Código grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "level": "Nivel de Formación",
    "modality": "Modalidad",
    "region": "Regional",
    "center": "Centro de Formación",
    "program_code": "Código Programa",
    "program": "Nombre de programa",
    "component": "Componente videoconferencia",
    "eventname": "Evento",
    "objecttable": "Tabla objeto",
    "objectid": "ID objeto",
    "first_text": "Primera actividad sesión",
    "last_text": "Última actividad sesión",
    "events": "Total eventos sesión",
    "users": "Usuarios participantes",
}

SESIONES_BBB = {
    "idnumber": "Código grupo/ficha",
    "fullname": "Nombre grupo/ficha en el LMS",
    "session_name": "Nombre sesión",
    "opening_text": "Fecha inicio sesión",
    "closing_text": "Fecha fin sesión",
    "users": "Usuarios participantes",
    "events": "Total eventos sesión",
}
