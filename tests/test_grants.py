from __future__ import annotations

from conftest import rows

from wayfreight.operators import grants


def read(make_files, text):
    return grants.grant_statements(make_files({("a", "x.sql"): text}))


def test_forms_of_statements(make_files):
    found = read(
        make_files,
        """-- GRANT ROLE no TO ROLE no;
        GRANT ALL PRIVILEGES ON ACCOUNT TO ROLE r; grant select (a, b), insert on view "My v".x to database role r with grant option;
        GRANT EXECUTE ON FUNCTION f(int, varchar) TO APPLICATION ROLE "r"; CREATE ROLE r; SELECT 'x' AS grant_to;
        GRANT SELECT ON TABLE t TO SHARE s; GRANT ROLE a TO USER b""",
    )
    assert rows(found, "privilege", "object_type", "object", "role", "grantee_kind", "grantee") == sorted(
        [
            ("ALL", "ACCOUNT", None, None, "ROLE", "R"),
            ("SELECT (A, B)", "VIEW", '"My v".x', None, "ROLE", "R"),
            ("INSERT", "VIEW", '"My v".x', None, "ROLE", "R"),
            ("EXECUTE", "FUNCTION", "F(INT, VARCHAR)", None, "ROLE", '"r"'),
            (None, None, None, "A", "USER", "B"),
        ],
        key=str,
    )


def test_long_texts_do_not_overflow(make_files):
    text = "GRANT SELECT ON " + "x" * 200_000 + " TO ROLE r;" + "GRANT " * 20_000 + '"' * 50_001 + "; GRANT ROLE a TO ROLE b;"
    assert read(make_files, text).filter("role = 'A'").count() == 1


def brute(edges):
    """Shortest chains by walking from each holder."""
    out = {}
    for holder in {h for h, _ in edges}:
        level, hops, seen = {holder}, 0, {}
        while level:
            hops += 1
            level = {r for h, r in edges if h in level} - set(seen)
            seen.update(dict.fromkeys(level, hops))
        out |= {(holder, r): n for r, n in seen.items()}
    return sorted((h, r, n) for (h, r), n in out.items())


def test_chains_and_cycles(make_files):
    edges = {(f"R{k}", f"R{k + 1}") for k in range(37)} | {("R20", "R11"), ("S", "R30"), ("S", "S"), ("R5", "R9")}
    statements = read(make_files, "".join(f"GRANT ROLE {r} TO ROLE {h};" for h, r in sorted(edges)))
    assert rows(grants.role_chains(statements), "grantee", "role", "hops") == sorted(brute(edges), key=str)


def test_plan_grants_a_role_after_what_it_holds(make_files):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "b"), ("a", "d")]
    text = "".join(f"GRANT ROLE {r} TO ROLE {h};" for h, r in edges) + "GRANT SELECT ON TABLE t TO ROLE d; GRANT ROLE a TO USER u; GRANT SELECT ON TABLE t TO USER u"
    statements = read(make_files, text)
    plan = grants.role_plan(statements, grants.role_chains(statements)).collect()
    assert {r.detail: r.level for r in plan if r.phase == 1} == {"A": 4, "B": 3, "C": 2, "D": 2, "E": 4}
    steps = {r.detail: r for r in plan if r.phase == 3}
    assert {d for d, r in steps.items() if r.action == "needs_review"} == {"C to ROLE D", "D to ROLE C"}
    assert steps["C to ROLE B"].level < steps["B to ROLE A"].level < steps["A to USER U"].level
    assert {r.detail for r in plan if r.phase == 2} == {"SELECT on TABLE T to ROLE D", "SELECT on TABLE T to USER U"}
    effective = grants.effective_grants(statements, grants.role_chains(statements))
    assert rows(effective.filter("hops = 0"), "grantee") == [("D",), ("U",)]
    assert rows(effective.filter("hops > 0"), "grantee", "hops") == [("A", 1), ("B", 2), ("C", 1), ("E", 3)]


def test_no_grants(make_files):
    statements = read(make_files, "SELECT 1")
    chains = grants.role_chains(statements)
    assert chains.count() == grants.effective_grants(statements, chains).count() == grants.role_plan(statements, chains).count() == 0
