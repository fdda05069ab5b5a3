"""Types of statements and of their parameters, over the schema of a small port authority."""

import pytest

from graphloom.catalog import Catalog
from graphloom.errors import FieldNotFound, FunctionNotFound, InvalidPath, MissingAuth, SchemaViolation, TableNotFound, TypeMismatch, Unimplemented, UnexpectedSyntax
from graphloom.kinds import array, parse_kind
from graphloom.plans.analyzer import analyze

SCHEMA = """
DEFINE TABLE quay; DEFINE FIELD label ON quay TYPE string; DEFINE FIELD depth ON quay TYPE float;
DEFINE FIELD crane.maker ON quay TYPE string; DEFINE FIELD crane.reach ON quay TYPE int;
DEFINE TABLE ship SCHEMAFULL; DEFINE FIELD title ON ship TYPE string; DEFINE FIELD tons ON ship TYPE int; DEFINE FIELD built ON ship TYPE datetime;
DEFINE FIELD hull ON ship TYPE { steel: bool, length: float, paint: string };
DEFINE FIELD home ON ship TYPE record<quay>; DEFINE FIELD sisters ON ship TYPE array<record<ship>>; DEFINE FIELD flags ON ship TYPE set<string>;
DEFINE FIELD pilot ON ship TYPE option<string>;
DEFINE TABLE moors TYPE RELATION FROM ship TO quay; DEFINE FIELD nights ON moors TYPE int; DEFINE FIELD fee ON moors TYPE number;
DEFINE TABLE tows TYPE RELATION FROM ship TO ship; DEFINE FIELD rope ON tows TYPE string;
"""
HULL = "{steel: bool, length: float, paint: string}"
SHIP = f"{{title: string, tons: int, built: datetime, hull: {HULL}, home: record<quay>, sisters: array<record<ship>>, flags: set<string>, pilot: option<string>}}"
QUAY = "{label: string, depth: float, crane: {maker: string, reach: int}}"


def kind_of(text: str):
    return parse_kind(text)


CASES = [
    # projections
    ("SELECT * FROM quay", f"array<{QUAY}>"),
    ("SELECT depth, label FROM quay", "array<{depth: float, label: string}>"),
    ("SELECT tons AS weight, built FROM ship", "array<{weight: int, built: datetime}>"),
    ("SELECT crane FROM quay", "array<{crane: {maker: string, reach: int}}>"),
    ("SELECT hull.length AS l FROM ship", "array<{l: float}>"),
    ("SELECT hull.{paint, steel} FROM ship", "array<{hull: {paint: string, steel: bool}}>"),
    ("SELECT hull.{paint, rust} AS skin FROM ship", "array<{skin: {paint: string}}>"),
    ("SELECT * OMIT label, crane.reach FROM quay", "array<{depth: float, crane: {maker: string}}>"),
    ("SELECT VALUE depth FROM quay", "[float]"),
    ("SELECT label FROM ONLY quay:north", "{label: string}"),
    ("SELECT pilot, flags FROM ship", "array<{pilot: option<string>, flags: set<string>}>"),
    # links
    ("SELECT home FROM ship", "array<{home: record<quay>}>"),
    ("SELECT home FROM ship FETCH home", f"array<{{home: {QUAY}}}>"),
    ("SELECT title, home.depth AS draught FROM ship", "array<{title: string, draught: float}>"),
    ("SELECT sisters FROM ship FETCH sisters", f"array<{{sisters: [{SHIP}]}}>"),
    # edges
    ("SELECT ->moors FROM ship", 'array<{"->moors": [record<moors>]}>'),
    ("SELECT ->moors->quay FROM ship", 'array<{"->moors": {"->quay": [record<quay>]}}>'),
    ("SELECT ->moors->quay.{label} FROM ship", 'array<{"->moors": {"->quay": [{label: string}]}}>'),
    ("SELECT ->moors->quay.* AS berths FROM ship", f"array<{{berths: [{QUAY}]}}>"),
    ("SELECT <-moors<-ship.title AS guests FROM quay", "array<{guests: [string]}>"),
    ("SELECT ->tows->ship->moors->quay.label AS led FROM ship", "array<{led: [string]}>"),
    # writes
    ("CREATE quay SET label = 'east', depth = 9.5", f"array<{QUAY}>"),
    ("CREATE ONLY quay CONTENT { label: 'east' }", QUAY),
    ("INSERT INTO quay { label: 'west', depth: 4.0 }", f"array<{QUAY}>"),
    ("UPSERT quay:west SET depth += 1.0", f"array<{QUAY}>"),
    ("UPDATE ship MERGE { tons: 7 } WHERE tons < 3", f"array<{SHIP}>"),
    ("DELETE quay WHERE depth < 2.0", "[]"),
    ("RELATE ship:orca->moors->quay:east", "array<{nights: int, fee: number}>"),
    # expressions
    ("SELECT string::uppercase(label) AS sign, depth * 2 AS twice FROM quay", "array<{sign: string, twice: number}>"),
    ("SELECT count() AS n, math::max(tons) AS most, home FROM ship GROUP BY home", "array<{n: int, most: number, home: record<quay>}>"),
    ("RETURN 3 < 4", "bool"),
]


@pytest.mark.parametrize("query, kind", CASES)
def test_types(query, kind):
    c = Catalog()
    analyze(c, SCHEMA)
    assert analyze(c, query) == array(kind_of(kind))


def test_several_statements_are_a_tuple():
    c = Catalog()
    analyze(c, SCHEMA)
    assert analyze(c, "SELECT label FROM quay; RETURN 1 = 1;") == kind_of("[array<{label: string}>, bool]")
    assert analyze(c, "") == kind_of("null")


PARAMS = [
    ("CREATE quay CONTENT $it", {"it": QUAY}),
    ("CREATE quay CONTENT { label: $a, depth: $b }", {"a": "string", "b": "float"}),
    ("UPDATE ship SET tons -= $less", {"less": "int"}),
    ("UPDATE ship SET hull.paint = $colour", {"colour": "string"}),
    ("UPDATE quay MERGE $part", {"part": QUAY}),
    ("UPDATE quay PATCH { depth: $deep }", {"deep": "float"}),
    ("RELATE $who->moors->quay:east", {"who": SHIP}),
    ("RELATE $who->moors->$where SET nights = $n", {"who": SHIP, "where": QUAY, "n": "int"}),
    ("INSERT INTO quay (label, depth) VALUES ($x, $y)", {"x": "string", "y": "float"}),
]


@pytest.mark.parametrize("query, params", PARAMS)
def test_params(query, params):
    c = Catalog()
    analyze(c, SCHEMA)
    analyze(c, query)
    assert c.params == {n: kind_of(k) for n, k in params.items()}


ERRORS = [
    ("SELECT label FROM lighthouse", TableNotFound),
    ("SELECT colour FROM quay", FieldNotFound),
    ("SELECT label FROM quay WHERE colour = 'red'", FieldNotFound),
    ("SELECT odd FROM quay", SchemaViolation),
    ("SELECT * FROM $auth", MissingAuth),
    ("SELECT * FROM $token", Unimplemented),
    ("SELECT sea::f(label) AS n FROM quay", FunctionNotFound),
    ("SELECT string::len(depth) AS n FROM quay", UnexpectedSyntax),
    ("SELECT VALUE label, depth FROM quay", UnexpectedSyntax),
    ("BEGIN", Unimplemented),
]


@pytest.mark.parametrize("query, error", ERRORS)
def test_errors(query, error):
    c = Catalog()
    analyze(c, SCHEMA + "DEFINE FIELD odd ON quay;")
    with pytest.raises(error) as e:
        analyze(c, query)
    assert "hint" in e.value.report()


def test_strict_mode():
    c = Catalog(strict=True)
    analyze(c, SCHEMA)
    for query in ("CREATE quay CONTENT { depth: 'deep' }", "DEFINE FIELD depth ON quay TYPE string"):
        with pytest.raises(TypeMismatch):
            analyze(c, query)
    analyze(c, "SELECT ->moors->quay AS q, <-tows<-ship AS s FROM ship")
    for path in ("<-moors<-ship", "->moors->ship", "->quay", "->tows->quay", "->moors->quay->moors"):
        with pytest.raises(InvalidPath):
            analyze(c, f"SELECT {path} AS x FROM ship")
