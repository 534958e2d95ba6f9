"""Text functions, front matter and payloads on hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwork import schemas
from loomwork.functions import frontmatter, payload
from loomwork.functions import text as tx


def one(spark, expression, **values):
    """The value of a column expression over one row of literals."""
    return spark.range(1).select(
        *(F.lit(v).alias(k) for k, v in values.items())
    ).select(expression.alias("out")).first().out


# YAML source of a value, and the text it must become
YAML_VALUES = [
    ("plain words", "plain words"), ("7", "7"), ("007", "7"), ("-2.50", "-2.5"), ("true", "true"), ("no", "false"), ("~", ""), ("", ""), ("1999-12-31", "1999-12-31"),
    ("'single: quoted'", "single: quoted"), ("[1, b, null]", '[1, "b", null]'), (
        "{z: 1, a: [x]}", '{"a": ["x"], "z": 1}'
    ), ("\n  - é\n  - 2020-01-02", '["é", "2020-01-02"]'), (">-\n  folded\n  lines", "folded lines"),
]


def front_matter_cases(n, seed=11):
    """Documents made from a random answer: (raw text, metadata, body)."""
    rng = random.Random(seed)
    for _ in range(n):
        fence = rng.choice(["closed", "open", "none"])
        eol = rng.choice(["\n", "\r\n"]) if fence == "closed" else "\n"
        want, lines = {"name": "", "description": ""}, []
        for key in rng.sample(["name", "description", "k1", "k2", "k3"], rng.randrange(1, 6)):
            if key in ("name", "description"):
                value = " ".join(rng.choice(["tide", "Gauge", "no. 4", "älter"]) for _ in range(rng.randrange(1, 4)))
                lines.append(f"{key}:{' ' * rng.randrange(1, 4)}{value}{' ' * rng.randrange(3)}")
                want[key] = value
            else:
                source, value = rng.choice(YAML_VALUES)
                lines.append(f"{key}: {source}")
                want[key] = value
        block = "\n".join(lines).replace("\n", eol)
        body = rng.choice(["", "# Title\n", "text\n---\nmore\n", "name: in the body\n"]) if fence == "closed" else ""
        raw = {
            "closed": f"---{eol}{block}{eol}---{eol}{body}", "open": f"---{eol}{block}{eol}", "none": block + eol
        }[fence]
        if "description" in want and want["description"] == "" and "name: in the body" in body and want["name"] == "":
            continue  # the pattern reads a name from the body then
        yield rng.choice(["", "\ufeff"]) + raw, want, body


def test_front_matter_of_known_answers(spark):
    cases = [c for c in front_matter_cases(120) if not (c[2].startswith("name:") and c[1]["name"] == "")]
    rows = spark.createDataFrame(
        [(i, c[0]) for i, c in enumerate(cases)], "i int, raw string"
    ).select("i", frontmatter.parse(F.col("raw")).alias("p")).collect()
    for r in rows:
        raw, want, body = cases[r.i]
        assert (r.p.metadata, r.p.body) == (want, body), raw


@pytest.mark.parametrize(
    ("raw", "want", "body"),
    [
        (None, {}, ""),
        ("\ufeff\ufeff", {}, ""),
        ("Only prose: no, two colons: here", {}, "Only prose: no, two colons: here"),
        ("- a\n- b\n", {}, "- a\n- b\n"),
        ("---\n  name: indented\n---\nx", {"name": "indented"}, "x"),
        ("---\nk: [1, 2\nname: still found\n---\nx", {"name": "still found"}, "x"),
        ("---\ndescription: >\n  two\n  lines\nname: n\n---", {"name": "n", "description": ">\n  two\n  lines"}, ""),
        ("---\ndescription: 2021-13-45\nwhen: 2021-13-45\n---\n", {"description": "2021-13-45"}, ""),
        ("---\n1: one\ntrue: flag\n---\n", {"1": "one", "True": "flag"}, ""),
        ("---\n---\nnothing between", {}, ""),  # no line between the fences: the first one stands alone
    ],
)
def test_front_matter_edges(spark, raw, want, body):
    got = one(spark, frontmatter.parse(F.col("t").cast("string")), t=raw)
    assert (got.metadata, got.body) == ({"name": "", "description": ""} | want, body)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("  plain ", "plain"),
        ('"quoted"', "quoted"),
        ('"a \\"b\\" c"', 'a "b" c'),
        ('"a" and "b"', 'a" and "b'),
        ("|\n\n  text", "text"),
        ('"| x"', "x"),
        ('"', '"'),
        ("", ""),
        ("\u00a0x\u00a0", "x"),
    ],
)
def test_normalize_field(spark, raw, want):
    assert one(spark, tx.normalize_field(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"), [
        ('["a", "b", null]', ["a", "b"]),
        ("plain text", ["plain text"]),
        ('"one"', ["one"]),
        ("7", ["7"]),
        ("  ", []),
        ("[broken", ["[broken"]),
        ('a "b", c', ['a "b", c']),
    ]
)
def test_string_list(spark, raw, want):
    assert one(spark, tx.string_list(F.col("t")), t=raw) == want


def test_tokenizers(spark):
    t = "The Qüick_2 brown-fox, and THE ẞ straße"
    assert one(spark, tx.words(F.col("t")), t=t) == ["qüick_2", "brown", "fox", "ß", "straße"]
    assert one(spark, tx.whitespace_tokens(F.col("t")), t=" A\u00a0b\tstraße ") == ["a", "b", "strasse"]
    assert one(spark, tx.words(F.col("t")), t=None) == []


def test_fold_is_full_case_folding(spark):
    """Against Python's, over letters with a case; those of one caseless form need only have one here too."""
    letters = [chr(i) for i in range(0x24F) if chr(i).isalpha()] + list("ΑΣςσΐᾳẞßﬁﬀŉǅſKµΆЖж") + ["ΌΔΟΣ", "straẞe", "ıI"]
    got = [
        r.f for r in spark.createDataFrame(
            [(i, c) for i, c in enumerate(letters)], "i int, c string"
        ).orderBy("i").select(tx.fold(F.col("c")).alias("f")).collect()
    ]
    assert [c for c, g in zip(letters, got, strict=True) if g != c.casefold()] == []


def test_small_functions(spark):
    assert [
        one(spark, tx.url_path(F.col("t")), t=x) for x in ("https://a.b/c/d/?x#y", "http://a.b", "v1/chat/", "", "/")
    ] == ["/c/d", "/", "/v1/chat", "/", "/"]
    assert one(
        spark, tx.has_other_script(F.col("t")), t="déjà vu"
    ) is False and one(spark, tx.has_other_script(F.col("t")), t="x ж") is True
    assert one(spark, tx.sanitize_name(F.col("t")), t="--") == "model" and one(
        spark, tx.sanitize_name(F.col("t")), t="/a b/C."
    ) == "a_b_C"
    assert one(
        spark, tx.decode_id("sm", F.col("t")), t="sm-12"
    ) == 12 and one(spark, tx.decode_id("sm", F.col("t")), t="x-12") is None
    assert one(spark, tx.render("{{a}}-{{ b }}-{{c}}", {"a": F.lit("{{b}}"), "b": F.lit("$1")})) == "$1-$1-"
    assert one(spark, tx.first_non_blank(F.lit(" "), F.lit(None).cast("string"), F.lit(" x "))) == "x"
    assert one(spark, tx.first_item(F.array(F.lit(" "), F.lit(" q ")))) == "q"
    assert one(spark, tx.with_instruction(F.lit(" "), F.lit(" t "))) == "t"
    assert one(
        spark, tx.between_marks(F.col("t"), "<<", ">>"), t="a << b >> c >>"
    ) == "b" and one(spark, tx.between_marks(F.col("t"), "<<", ">>"), t=" a ") == "a"
    assert one(spark, tx.safe_divide(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, tx.numbered_list(F.array(F.lit("a"), F.lit("b")))) == "  1. a\n  2. b"
    assert tx.parse_bool("Yes") and not tx.parse_bool("", strict=False)
    with pytest.raises(ValueError):
        tx.parse_bool("maybe")
    meta = one(spark, tx.base_metadata(F.create_map(F.lit("k"), F.lit("v"))))
    assert meta == {"source_k": "v", "source_metadata_json": '{"k":"v"}'}


GOOD = {"summary": "s", "seed_questions": ["a"]}


@pytest.mark.parametrize(
    ("value", "ok"),
    [
        (GOOD, True),
        (GOOD | {"x": 1}, False),
        ({"summary": "s"}, False),
        (GOOD | {"summary": 3}, False),
        (GOOD | {"seed_questions": [1]}, False),
        (GOOD | {"seed_questions": "a"}, False),
        (GOOD | {"seed_questions": []}, True),
        ([GOOD], False),
        (None, False),
    ],
)
def test_strict_payload(spark, value, ok):
    assert one(spark, payload.is_valid(F.col("t"), schemas.SUMMARY), t=json.dumps(value)) is ok


def test_payload_lengths(spark):
    pair = {"scenario": "s", "question": "q"}
    for value, ok in (([pair] * 5, True), ([pair] * 4, False), ([pair] * 4 + [{"scenario": "s"}], False)):
        assert one(
            spark, payload.is_valid(F.col("t"), schemas.SCENARIOS), t=json.dumps({"scenario_output": value})
        ) is ok
    assert one(spark, payload.is_valid(F.col("t"), schemas.SUMMARY), t="not json") is False
    for n, ok in ((5, True), (4, False), (6, False)):
        assert one(
            spark,
            payload.is_valid(F.col("t"), schemas.FILTERED),
            t=json.dumps({"reasoning": "r", "filtered_questions": ["q"] * n}),
        ) is ok
    said = {"reasoning": "r", "what": "w", "why": "y", "seed_questions": ["q"]}
    assert one(spark, payload.is_valid(F.col("t"), schemas.EXTRACTION), t=json.dumps(said)) is True
    assert one(spark, payload.is_valid(F.col("t"), schemas.EXTRACTION), t=json.dumps(said | {"why": None})) is False


def test_response_content(spark):
    body = lambda content, status=200: json.dumps(
        {"status_code": status, "body": {"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 3}}}
    )
    get = payload.content(F.col("e"), F.col("r"))
    assert one(spark, get, e=None, r=body("x")) == "x"
    assert [
        one(spark, get, e=e, r=r) for e,
        r in (
            ("bad", body("x")), (None, body("  ")), (None, body(5)), (None, body("x", 500)), (None, "{}"), (None, None)
        )
    ] == [None] * 6
    assert one(spark, payload.usage(F.col("r")), r=body("x")).asDict() == {
        "prompt_tokens": 3, "completion_tokens": 0, "total_tokens": 0
    }
    assert one(spark, payload.usage(F.col("r")), r="{}") is None


def test_requests(spark):
    line = one(spark, payload.request_line(F.lit("sm-1"), F.lit("m"), F.lit("sys"), F.lit("use"), F.lit(5)))
    assert json.loads(line) == {
        "custom_id": "sm-1",
        "method": "POST",
        "url": "/v1/chat/completions",
        "body": {
            "model": "m",
            "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "use"}],
            "max_tokens": 5,
        },
    }
    body = json.dumps({"messages": [3, {"role": "user", "content": [1]}, {"role": "user", "content": "two words"}]})
    assert one(
        spark, payload.first_user_text(F.col("b")), b=body
    ) == "two words" and one(spark, payload.message_tokens(F.col("b")), b=body) == 2
    assert one(spark, payload.message_tokens(F.col("b")), b="broken") == 0
    assert one(
        spark, payload.metadata_map(F.col("b")), b='{"name": "n", "x": {"b": 1}, "y": null}'
    ) == {"name": "n", "x": '{"b":1}', "y": "", "description": ""}
