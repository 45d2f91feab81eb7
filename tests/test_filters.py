"""A filtered report holds exactly the rows of the unfiltered one that its filter keeps.

The rows are hand-made so that forum, module, log and enrolment disagree about the course.
"""

import pytest

from lectern.plans import reports, variants
from tests.lms import event, tables

COURSES = {2: "A2", 3: "B3"}
AT = 1704700000


def _tables(spark):
    courses = [
        {"id": i, "idnumber": code, "shortname": code, "fullname": f"Curso {code}", "category": 1, "visible": 1, "startdate": AT, "enddate": 0,
         "timecreated": AT}
        for i, code in COURSES.items()
    ]
    users = [
        {"id": u, "username": f"{u}00cc", "idnumber": f"{u}00cc", "firstname": f"N{u}", "lastname": "L", "deleted": 0, "suspended": 0, "auth": "manual",
         "timecreated": AT, "email": "x"}
        for u in (5, 6)
    ]
    modules = [
        {"id": 21, "course": 2, "module": 1, "instance": 31, "deletioninprogress": 0},  # forum of course 3
        {"id": 22, "course": 3, "module": 1, "instance": 32, "deletioninprogress": 0},  # forum of course 2
        {"id": 23, "course": 2, "module": 2, "instance": 31, "deletioninprogress": 0},  # quiz with a forum's number
        {"id": 24, "course": 2, "module": 1, "instance": 99, "deletioninprogress": 0},  # no such forum
    ]
    rows = [(c, u, m) for c in COURSES for u in (5, 6) for m in (21, 22, 23, 24)]  # modules of other courses too
    log = [event(10 + n, u, c, AT + 60 * n, contextlevel=70, contextinstanceid=m, component="mod_forum") for n, (c, u, m) in enumerate(rows)]
    log += [event(100 + n, u, c, AT + 4000 + n) for n, (c, u, m) in enumerate(rows)]
    return tables(
        spark,
        mdl_course=courses,
        mdl_user=users,
        mdl_enrol=[{"id": i, "courseid": i, "status": 0} for i in COURSES],
        mdl_user_enrolments=[
            {"id": 10 * c + u, "enrolid": c, "userid": u, "status": 0, "timestart": 0, "timeend": 0, "timecreated": AT} for c in COURSES for u in (5, 6)
        ],
        mdl_role=[{"id": 1, "shortname": "student", "name": "Aprendiz"}],
        mdl_context=[{"id": i, "contextlevel": 50, "instanceid": i} for i in COURSES],
        mdl_role_assignments=[{"id": 10 * c + u, "roleid": 1, "userid": u, "contextid": c} for c in COURSES for u in (5, 6)],
        mdl_course_modules=modules,
        mdl_modules=[{"id": 1, "name": "forum"}, {"id": 2, "name": "quiz"}],
        mdl_forum=[{"id": 31, "course": 3, "type": "news"}, {"id": 32, "course": 2, "type": "blog"}],
        mdl_forum_discussions=[{"id": 41, "forum": 31, "userid": 5, "course": 2, "timemodified": AT}, {"id": 42, "forum": 32, "userid": 6, "course": 3, "timemodified": AT}],
        mdl_forum_posts=[{"id": 50 + n, "discussion": d, "userid": u, "parent": n % 2, "created": AT} for n, (d, u) in enumerate([(41, 5), (41, 6), (42, 5), (42, 6)])],
        mdl_logstore_standard_log=log,
    )


@pytest.mark.parametrize(
    "run",
    [
        reports.registro_usuarios, reports.matriculas_lms, reports.fichas_programas, reports.uso_herramientas, reports.participacion_herramientas,
        reports.tiempo_permanencia, variants.uso_herramientas_simple, variants.participacion_total, variants.fichas_roles_outer,
        variants.matriculas_activas, variants.registro_por_matricula,
    ],
    ids=lambda run: run.__name__,
)
@pytest.mark.parametrize("code", ["A2", "B3"])
def test_course_filter_cuts_the_whole_report(spark, settings, run, code):
    t = _tables(spark)
    whole = run(t, None, settings).collect()
    column = next(c for c in whole[0].asDict() if whole[0][c] in COURSES.values())
    kept = sorted(str(r) for r in whole if r[column] == code)
    assert kept and sorted(str(r) for r in run(t, {"codigo_ficha": code}, settings).collect()) == kept


@pytest.mark.parametrize("run", [reports.registro_usuarios, reports.participacion_herramientas, reports.tiempo_permanencia], ids=lambda run: run.__name__)
def test_person_filter_cuts_the_whole_report(spark, settings, run):
    t = _tables(spark)
    whole = run(t, None, settings).collect()
    kept = sorted(str(r) for r in whole if "N5 L" in r.asDict().values())
    assert kept and sorted(str(r) for r in run(t, {"nombres_apellidos": "N5"}, settings).collect()) == kept


def test_forum_types_survive_a_course_filter(spark, settings):
    row = reports.uso_herramientas(_tables(spark), {"codigo_ficha": "A2"}, settings).first().asDict()
    counts = {k: v for k, v in row.items() if "nuncio" in k or "oro" in k}
    assert 1 in counts.values(), counts
