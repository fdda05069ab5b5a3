"""Secrets that are set without a digit, in few characters, or inside of an address."""

from graphloom.llm import secrets

SECRET = {
    'password = "hunter2"': "hunter2",
    "password: S3cr3t!pw": "S3cr3t!pw",
    'api_key = "abcdefghijklmnopqrstuvwx"': "abcdefghijklmnopqrstuvwx",
    "postgres://bob:p4ssw0rd@host/db": "p4ssw0rd",
    "DB_PASSWORD=Tr0ub4dor&3, DB_USER=bob": "Tr0ub4dor&3",
    r"{\"password\": \"hunter22\"}": "hunter22",
    "é\U0001f600 token=abc1x2z;user=bob": "abc1x2z",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"': "04dbebab91ab85687d33eeaaf9ac699e1188f962",
}
HARMLESS = ["password: required", 'password = "Enter your password"', 'password = os.environ["DB"]', "secret: ${SECRET_VALUE}", "postgres://bob:${PASS}@host", "key: /usr/lib/config"]


def reports(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.report(df).collect()}
    return [rows[i] for i in range(len(texts))]


def test_values_are_candidates_and_secrets(spark):
    for text, row in zip(SECRET, reports(spark, list(SECRET)), strict=True):
        places = [tuple(map(int, s.split(":"))) for s in row.spans.split(",") if s]
        assert [text[a:b] for a, b in places] == [SECRET[text]], (text, row)
        assert row.n_candidates == row.n_secrets == 1


def test_forest_rejects_what_only_looks_set(spark):
    for text, row in zip(HARMLESS, reports(spark, HARMLESS), strict=True):
        assert row.n_candidates == 1 and row.n_secrets == 0, (text, row)


def test_long_values_and_blanks(spark):
    texts = ["password=" + "aB3$" * 20_000, "key" + " " * 50_000 + "= x", "://" * 20_000, "key=" * 20_000, 'pwd="' * 5_000]
    assert [r.n_candidates > 0 for r in reports(spark, texts)][0]


def test_forest_learns_from_all_over_a_large_table(spark):
    """Half of the findings sort before the other half, which alone tells of secrets."""
    from pyspark.sql import functions as F

    made = spark.range(12_000).selectExpr("if(id < 6000, concat('/A', id), concat('ghp_', sha2(cast(id as string), 256))) m", "'see ' left", "if(id < 6000, 0, 1) label")
    forest = secrets.train(made)
    row = spark.range(1).select(secrets.score(forest, secrets.features(F.concat(F.lit("ghp_"), F.sha2(F.lit("x"), 256)), F.lit("see "))).alias("p")).first()
    assert row.p > 0.5
