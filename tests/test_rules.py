"""The rows that rules are held against: each rule is broken by some and kept by some, and nulls occur in every column that may have them."""

from framewright.operators import quality
from framewright.plans import ORACLE_SQL, rules

from .compare import duck


def test_every_rule_is_broken_and_kept():
    con = duck("/root/testdata/sf0.01")
    found = {(relation, rule): n for relation, rule, n, *_ in con.sql(ORACLE_SQL["every_rule"]).fetchall()}
    every = {(relation, r.name + "_exists" * isinstance(r, quality.Reference)) for relation, own in quality.RULES.items() for r in own}
    assert set(found) == every and max(found.values()) < con.sql("SELECT count(*) FROM events").fetchall()[0][0]


def test_columns_take_nulls():
    for relation in quality.RULES:
        for column in rules.columns_of(relation):
            _, values = rules._pick(relation, column)
            key = (relation, column) in {("projects", "id_project"), ("locations", "location_id"), ("persons", "person_id")}
            assert values is None or key or "NULL" in values, (relation, column)
