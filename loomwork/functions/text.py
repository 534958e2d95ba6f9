"""Column expressions on text. Everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the stop words of the word tokenizer
STOPWORDS = [
    "a",
    "an",
    "and",
    "are",
    "as",
    "at",
    "be",
    "by",
    "for",
    "from",
    "in",
    "is",
    "it",
    "of",
    "on",
    "or",
    "that",
    "the",
    "this",
    "to",
    "was",
    "were",
    "will",
    "with",
]

# fixed values: code point ranges of the scripts that mark a text as not written in the Latin script
SCRIPTS = [
    (0x0400, 0x052F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0750, 0x077F), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F),
    (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF), (0x0D00, 0x0D7F), (0x0E00, 0x0E7F),
    (0x0E80, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x3040, 0x309F), (0x30A0, 0x30FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7AF),
]

SCRIPT_CLASS = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in SCRIPTS) + "]"


def trim(c: Column) -> Column:
    """Strip white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def fold(c: Column) -> Column:
    """Full case folding: the lower case of the upper case, in which sharp s, ligatures and the like spell out.

    Both sharp s become ss, final sigma is any sigma, and the dotless i, whose upper case has a dot to lose, stays.
    """
    dotless = F.translate(F.lower(c), "\u0131", "\ue0f1")  # kept apart by a private character
    # what stands between upper and lower also keeps the optimizer from taking them for lower alone
    upper = F.translate(F.upper(dotless), "\ue0f1", "\u0131")
    full = F.translate(F.replace(F.lower(upper), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(full)  # ASCII has only lower case


def is_blank(c: Column) -> Column:
    return F.coalesce(trim(c), F.lit("")) == ""


def not_blank(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def words(c: Column, remove_stopwords: bool = True) -> Column:
    """Lower-case runs of letters, digits and underscores; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(found, lambda t: ~t.isin(STOPWORDS)) if remove_stopwords else found


def whitespace_tokens(c: Column, caseless: bool = True) -> Column:
    """Runs of anything but white space, folded or only lower-cased."""
    text = F.coalesce(c, F.lit(""))
    return F.array_remove(F.split(fold(text) if caseless else F.lower(text), r"(?U)\s+"), "")


def has_other_script(c: Column) -> Column:
    """Whether any character is of a script in SCRIPTS."""
    return F.coalesce(c.rlike(SCRIPT_CLASS), F.lit(False))


def token_count_ok(tokens: Column, most: int = 63_000) -> Column:
    """Neither empty nor longer than `most`."""
    return (tokens > 0) & (tokens <= most)


def normalize_field(c: Column) -> Column:
    """Trim; unwrap one layer of JSON string quotes (plain slicing if it doesn't decode); strip one leading pipe, then
    the line breaks and then the blanks behind it."""
    t = trim(F.coalesce(c, F.lit("")))
    quoted = (F.char_length(t) >= 2) & t.startswith('"') & t.endswith('"')
    parsed = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")
    inner = F.when(F.size(parsed) == 1, trim(F.get(parsed, 0))).otherwise(
        trim(F.substr(t, F.lit(2), F.char_length(t) - 2))
    )
    bare = F.when(quoted, F.coalesce(inner, trim(F.substr(t, F.lit(2), F.char_length(t) - 2)))).otherwise(t)
    return F.when(
        bare.startswith("|"), F.regexp_replace(F.regexp_replace(F.substr(bare, F.lit(2)), r"^\n+", ""), r"^[ \t]+", "")
    ).otherwise(bare)


def string_list(c: Column) -> Column:
    """A text that holds a JSON list gives its non-null items, another JSON scalar or plain text itself, blank nothing."""
    t = trim(F.coalesce(c, F.lit("")))
    items = F.filter(F.from_json(t, "array<string>"), lambda x: x.isNotNull())
    single = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 0), t)
    whole = F.when(F.size(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")) == 1, single).otherwise(t)
    return F.when(t == "", F.array().cast("array<string>")).when(
        t.startswith("["), F.coalesce(items, F.array(t))
    ).otherwise(F.array(whole))


def non_blank_items(c: Column) -> Column:
    return F.filter(c, lambda x: ~is_blank(x))


def first_non_blank(*candidates: Column) -> Column:
    """The first candidate with something in it, trimmed; empty if none has."""
    return F.coalesce(*map(not_blank, candidates), F.lit(""))


def first_item(items: Column) -> Column:
    """The first non-blank item of an array, trimmed; null if there is none."""
    return trim(F.get(non_blank_items(items), 0))


def with_instruction(instruction: Column, text: Column) -> Column:
    """The instruction on a line of its own, if it isn't blank, before the text."""
    return F.concat_ws("\n", not_blank(instruction), trim(text))


def url_path(c: Column) -> Column:
    """The path of a URL or path: without scheme and host, with a leading slash, without trailing ones; `/` if empty."""
    t = trim(F.coalesce(c, F.lit("")))
    path = F.when(t.rlike(r"^https?://"), F.regexp_extract(t, r"^https?://[^/?#]*([^?#]*)", 1)).otherwise(t)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    bare = F.regexp_replace(path, r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def sanitize_name(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore, none at the ends; `model` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(t == "", "model").otherwise(t)


def encode_id(prefix: str, number: Column) -> Column:
    """prefix-number."""
    return F.concat(F.lit(f"{prefix}-"), number.cast("string"))


def decode_id(prefix: str, c: Column) -> Column:
    """The number of an id of encode_id; null if the prefix or the number is missing."""
    return F.when(c.startswith(f"{prefix}-"), F.substr(c, F.lit(len(prefix) + 2)).try_cast("bigint"))


def sha_fragment(c: Column, length: int = 24) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(length))


def render(template: str | Column, variables: dict[str, Column]) -> Column:
    """Replace each `{{ name }}` by its variable, one name after the other in the order of the dict; others vanish."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in variables.items():
        mark = F.lit("\x00" + name + "\x00")
        out = F.replace(
            F.regexp_replace(out, r"\{\{\s*" + name + r"\s*\}\}", "\x00" + name + "\x00"),
            mark,
            F.coalesce(value, F.lit("")),
        )
    return F.regexp_replace(out, r"\{\{\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\}\}", "")


def numbered_list(items: Column) -> Column:
    """`  1. first` and so on, one per line."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n"
    )


def shorten(c: Column, most: int = 200) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def scrub(c: Column) -> Column:
    """Invalid UTF-8 (lone surrogates and the like) becomes U+FFFD."""
    return F.make_valid_utf8(c)


def between_marks(c: Column, begin: str, end: str) -> Column:
    """What stands between two marks, trimmed; the whole text, trimmed, if they aren't there."""
    import re

    quote = lambda x: re.sub(r"([^\w\s])", r"\\\1", x)
    pattern = rf"(?s){quote(begin)}(?U)\s*(.*?)\s*{quote(end)}"
    return F.when(c.rlike(pattern), trim(F.regexp_extract(c, pattern, 1))).otherwise(trim(F.coalesce(c, F.lit(""))))


def choose_field(name: str, fields: tuple[str, ...] = ("summary", "description")) -> str:
    """The name of a text field in any case; an error for others."""
    found = name.strip().lower()
    if found not in fields:
        raise ValueError(f"unknown field {name!r}, one of {', '.join(fields)} is wanted")
    return found


def stem(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?/*$", 1)


def suffix(path: Column) -> Column:
    """The suffix of a path's last part, with its dot; empty without one."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def shard_path(path: Column, number: Column, first_bare: bool = True) -> Column:
    """Paths of numbered shards: stem_<number> with the suffix, the number 0 without one if first_bare."""
    numbered = F.concat(
        F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("_"), number.cast("string"), suffix(path)
    )
    return F.when(number == 0, path).otherwise(numbered) if first_bare else numbered


def path_list(c: Column) -> Column:
    """Paths given as a JSON list or separated by commas, trimmed, blanks left out."""
    t = trim(F.coalesce(c, F.lit("")))
    parts = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(t, ","))
    return F.transform(non_blank_items(F.coalesce(parts, F.array().cast("array<string>"))), trim)


def stays_inside(path: Column) -> Column:
    """Whether a relative path leads nowhere above where it starts: not absolute, and at no point more steps up than down."""
    steps = F.transform(
        F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), lambda p: F.when(p == "..", -1).otherwise(1)
    )
    low = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, s: F.struct((a["at"] + s).alias("at"), F.least(a["low"], a["at"] + s).alias("low")),
    )
    return ~path.startswith("/") & (low["low"] >= 0)


def document_prompt(intro: Column, document: Column, marks: tuple[str, str]) -> Column:
    """An instruction, and a document between two marks, each on lines of their own."""
    return F.concat_ws("\n", intro, F.lit(marks[0]), document, F.lit(marks[1]))


def question_prompt(template: str, name: Column, description: Column, questions: Column) -> Column:
    """A template with the name, the description and the numbered questions of a row."""
    return render(template, {"name": name, "description": description, "questions": numbered_list(questions)})


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of the lower-cased texts, in code points."""
    return F.levenshtein(F.lower(a), F.lower(b))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def is_missing(c: Column) -> Column:
    """Null or NaN."""
    return c.isNull() | F.isnan(c.try_cast("double")).eqNullSafe(True)


def base_metadata(metadata: Column, **extra: Column) -> Column:
    """source_<key> entries of a metadata map, and the map itself as JSON."""
    named = F.transform_keys(
        F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("source_"), k)
    )
    own = F.create_map(
        F.lit("source_metadata_json"),
        F.to_json(metadata),
        *(x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))),
    )
    return F.map_concat(named, own)


def parse_bool(text: str, strict: bool = True) -> bool:
    """Driver-side flag: true/1/yes/on and false/0/no/off (and empty); anything else is an error, or false if lenient."""
    t = str(text).strip().lower()
    if t in {"true", "1", "yes", "y", "on"}:
        return True
    if t in {"false", "0", "no", "n", "off", "", "none"} or not strict:
        return False
    raise ValueError(f"not a flag: {text!r}")
