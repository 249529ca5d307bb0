import pytest

from skein.llm import residue as operator
from skein.llm import wording
from skein.llm.residue import explain, fold, inspect, residue

CASES = [
    "The build is done. Version {{ version }} was published on 2026-01-01.",
    "Hello ${FIRST_NAME}, your index is ready.",
    "Owner: [INSERT OWNER HERE]",
    "Contact <your team here> if the check fails.",
    "Signed by ____ (first name) today.",
    "Lorem ipsum dolor sit amet consectetur.",
    "text text text text text text text",
    "Some real words first. TODO: write this section",
    "Item 1\nItem description goes here",
    "404 Not Found",
    "Menu\nSkip to content\nSomething went wrong. Try again in a few minutes.",
    "Access denied. You do not have permission to view this page on a.example.",
    "<html><head><title>Bad Gateway</title></head><body><h1>Bad Gateway</h1></body></html>",
    '{"error":{"code":403,"message":"not found"}}',
    "Please enable JavaScript to view this page.",
    "Real words open this page. … Upstream request timed out after 52 s. Request id dc19.",
    "Sie müssen warten. Für diese Ansicht müssen Skripte im Browser erlaubt sein.",
    "Platzhaltertext, bitte ersetzen.",
]
OTHERS = [
    None, "", "  \n", "ok", "404 rows", "503 edges, 404 nodes", "todo list moved", "JavaScript files: 7281", "test 12",
    "access denied by read_table, see src/a/b.py", "error in lib/x.ts:5", "load_x timed out after 30 ms",
    "The renderer replaces `{{ link }}` with the value in store.",
    "```yaml\nruns-on: ${{ matrix.os }}\n```\nThe job is green.",
    'Handlers must map a missing page to "404 Not Found" and a lost one to "502 Bad Gateway".',
    "Each dunder such as `__init__` is skipped. See lib/a/__init__.py.",
    "Fixture `x.html` holds the sentence \"Something went wrong\" and nothing else.",
    "The JavaScript frontend must be enabled in the build profile before scripts are indexed.",
    "We measured 13966 of them. That took 404 ms on 2026-01-02.",
    "The similarity fixture fills its comments with `lorem ipsum` words.",
    "WARN  [bracket] match took 6268ms (limit=828) path=tools/a.py",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert inspect(text)[0]


@pytest.mark.parametrize("text", [t for t in OTHERS if t and t.strip()])
def test_no_cases(text):
    flagged, doubts, _ = inspect(text)
    assert not flagged and not [d for d in doubts if d[0] == "weak"]


def test_fold():
    assert fold("Dié\tGrößé  X") == "die grosse x"


def test_alignment_settles_doubtful_slots(spark):
    aligned = [(1, "Release notes by {author} are ready."), (2, "Release notes by `Ann` are ready."), (3, "Release notes by 12 are ready.")]
    lone = [(4, "Only here stands {something} odd.")]
    blank = [(5, "Release notes by  are ready."), (6, "Release notes by undefined are ready.")]
    rest = [(100 + i, t) for i, t in enumerate(OTHERS)] + [(200 + i, t) for i, t in enumerate(CASES)] + [(200, CASES[0]), (None, CASES[0])]
    df = spark.createDataFrame(aligned + lone + blank + rest, "doc_id int, text string").selectExpr("*", "'x' AS form", "1 AS key")
    got = {r.doc_id for r in residue(df, "doc_id", "text").collect()}
    assert got == {1, 5, 6, None} | {200 + i for i in range(len(CASES))}


def test_order_and_partitions_do_not_matter(spark):
    data = [(i, t) for i, t in enumerate(CASES + OTHERS)]
    results = []
    for n in (1, 7):
        df = spark.createDataFrame(data[::-1] if n == 1 else data, "doc_id int, text string").repartition(n)
        results.append(sorted(r.doc_id for r in residue(df, "doc_id", "text").collect()))
    assert results[0] == results[1] == list(range(len(CASES)))
    assert residue(df.limit(0), "doc_id", "text").count() == 0


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id for r in residue(df, "doc_id", "text").collect()}


def test_repeated_page_of_unlisted_wording(spark):
    page = "We are unable to open your workspace. Contact support about this account, number {}."
    lone = "We were unable to show your basket. Contact support about this account."
    note = "The index was rebuilt at night. All {} rows are in place."
    texts = [page.format(1), "Real words open it.\n" + page.format(2), lone, note.format(3), note.format(4)]
    assert found(spark, texts) == {0, 1}


def test_repeated_error_page_of_any_length(spark):
    rest = "\nThe tide had carried every boat of the harbour out to sea before the morning bells began to ring over the town."
    other = "\nAnother sentence stands here that shares nothing with its neighbours and goes on for well over eighty characters."
    first = "The tables of the northern archive were counted twice in autumn. " * 8
    texts = ["404 Not Found" + rest, "404 Not Found" + rest, "404 Not Found" + other]
    texts += [first + f"Count {i}.\n502 Bad Gateway" for i in range(2)]
    assert found(spark, texts) == {0, 1, 3, 4}


@pytest.mark.parametrize(
    "text",
    [
        "Down for maintenance until 14:30 UTC.",
        "The page /docs/a_b.html could not be loaded.",
        "Please sign in to continue and/or register.",
        "TODO: describe lib/a/b.py",
    ],
)
def test_code_tokens_do_not_hide_the_wording(text):
    assert inspect(text)[0]


def test_sentences_about_code_are_no_case(spark):
    told = ["Replaced the placeholder text in lib/a/b.ts with real words.", "An error page is cached for 1 s, then split_window tries again."]
    assert found(spark, told + told) == set()


@pytest.mark.parametrize("few", [100_000, 0])
def test_slots_filled_with_plain_words(spark, monkeypatch, few):
    monkeypatch.setattr(operator, "_FEW", few)
    good = ["Release notes by Ann are ready.", "Release notes by Ben Carter are ready.", "Dear Ann, your copy of Dune is waiting.", "Dear Ben, your copy of Emma is waiting."]
    bad = ["Release notes by {author} are ready.", "Release notes by undefined are ready.", "Release notes by  are ready.", "Release notes by n/a are ready."]
    bad += ["Dear  , your copy of  is waiting."]
    lone = ["Only here stands  nothing at all today.", "The value of that field is none of ours."]
    assert found(spark, good + bad + lone) == {4, 5, 6, 7, 8}


def test_three_blanks_at_once_and_long_units(spark):
    told = "The committee of the northern harbour has read the report on {} by {} of {} and agrees with each of its many findings, whatever the weather on that day and however long the reading of it took"
    texts = [told.format("tides", "Ann", "Hull"), told.format("winds", "Ben", "York"), told.format("{topic}", "undefined", " ")]
    assert found(spark, texts) == {2}


def test_reasons(spark):
    texts = ["Version {{a}} was out on Monday.", "Version 12 was out on Monday.", "Only here {{b}} stands.", "404 Not Found", "404 Not Found", "lorem ipsum dolor", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted((r.doc_id, r.reason, r.aligned) for r in explain(df, "doc_id", "text").collect()) == [
        (0, "mark", True), (2, "alone", False), (3, "page", True), (4, "page", True), (5, "alone", False),
    ]


@pytest.mark.parametrize("text", CASES)
def test_no_pattern_matches_without_its_literals(text):
    folded = fold(text)
    for pattern, bit in ((wording._FILLER, wording.FILLER), (wording._ERROR, wording.ERROR), (wording._NOTICE, wording.NOTICE)):
        assert not pattern.search(folded) or wording.bits(folded) & bit
