"""Parsing of answers, paths, votes and tool calls, and detection of references to votes."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

# Fixed value: words about voting in a post, as the samples' filter sees them.
VOTE_LANGUAGE = r"(?i)(score\s*of|scored|\bvote[sd]?\b|high[\-]?scoring|negative[\-]?scoring|anonymous\s+(?:vote|scientist)|consensus)"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def score_text(c: Column) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), c.cast("string"))


#: Fixed value: the names that texts may hold.
PARTICIPANT = r"\bScientist_\d+\b"


def substitute_names(text: Column, names: Column) -> Column:
    """Each Scientist_7 in the text by its entry in the map, in one pass; unknown names, and names of other kinds, stay."""
    words = F.regexp_extract_all(text, F.lit(rf"(?s)({PARTICIPANT})|((?:(?!{PARTICIPANT}).)+)"), F.lit(0))
    mapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.when(names.isNull() | text.isNull(), text).otherwise(F.array_join(mapped, ""))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


# Where answers give their letter, and where gold answers do.
LETTER_GIVEN = r"(?iU)\\boxed\{\s*([A-D])\s*\}|(?:answer is|answer:|final answer)\s*\(?\s*([A-D])\s*\)?"
LETTER_SAID = r"(?iU)(?:answer is|answer:)\s*\(?\s*([ABCD])\s*\)?"
GOLD_LETTER = r"(?U)\\boxed\{\s*([A-D])\s*\}"
BOX = r"(?s)\\boxed\{(.+?)\}"


def boxed_letter(text: Column) -> Column:
    """The letter given last, in a box by itself or after words that announce it, upper case, or null."""
    return F.upper(F.concat(last_match(text, LETTER_GIVEN, 1), last_match(text, LETTER_GIVEN, 2)))


def answer_letter(text: Column) -> Column:
    """The letter of the last `answer is` or `answer:`, with or without brackets, upper case, or null."""
    return F.upper(last_match(text, LETTER_SAID, 1))


def unboxed(text: Column) -> Column:
    """The inside of the first box up to its first closing brace, or the text itself, stripped."""
    return strip(F.when(text.rlike(BOX), F.regexp_extract(text, BOX, 1)).otherwise(text))


def normal_answer(text: Column) -> Column:
    """A free answer for comparison: white space gathered, surrounding dollar signs gone, lower case."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(strip(text), r"(?U)\s+", " "), r"^\$+|\$+$|^\\\(|\\\)$", "")))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def tail(text: Column, n: int = 500) -> Column:
    return F.right(text, F.lit(n))


def category_prefix(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def session_in_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|/)sessions/([^/]+)", 1), F.lit(""))


def slot_index(name: Column) -> Column:
    """6 for Name_7; -1 for names without a number."""
    return F.coalesce(F.expr(f"try_cast(substring_index({_sql(name)}, '_', -1) as int)") - 1, F.lit(-1))


def _sql(c: Column) -> str:
    name = c._jc.toString()
    return f"`{name}`"


def to_integer(c: Column) -> Column:
    """The whole number that a text is, or null: signs before it, blanks around it and single underscores between digits are allowed, fractions
    aren't. Numbers beyond a long are null."""
    digits = strip(F.regexp_replace(strip(c.cast("string")), r"^\++", ""))
    return F.when(digits.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint"))


def json_integer(value: Column) -> Column:
    """The whole number of a JSON value (variant), or null: numbers lose their fraction, texts are read as to_integer does, true is 1."""
    kind = F.schema_of_variant(value)
    as_kind = lambda t: F.try_variant_get(value, "$", t)
    return (
        F.when(kind == "STRING", to_integer(as_kind("string")))
        .when(kind == "BIGINT", as_kind("bigint"))
        .when(kind == "BOOLEAN", as_kind("boolean").cast("bigint"))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), as_kind("double").try_cast("bigint"))
    )


def first_text(body: Column, keys: list[str]) -> Column:
    """The first non-empty text among the keys of a JSON object, in their order, stripped; '' without any. Numbers, lists and objects are no texts."""
    parsed = F.try_parse_json(body)
    value = lambda k: F.try_variant_get(parsed, f"$.{k}", "variant")
    texts = [F.nullif(F.when(F.schema_of_variant(value(k)) == "STRING", F.try_variant_get(parsed, f"$.{k}", "string")), F.lit("")) for k in keys]
    return strip(F.coalesce(*texts, F.lit("")))


def first_integer(body: Column, keys: list[str]) -> Column:
    """The first whole number among the keys of a JSON object, in their order, as json_integer reads it."""
    parsed = F.try_parse_json(body)
    return F.coalesce(*(json_integer(F.try_variant_get(parsed, f"$.{k}", "variant")) for k in keys))


def vote_list(argument: Column) -> Column:
    """A votes argument, given as JSON, as array<struct<target_type string, target_id long, value long>>: a list, one object, or either as JSON in a text.
    Without a type the target is a post; numbers are read as json_integer does. Anything else gives no votes, an unreadable text also an error (vote_list_error)."""
    votes = _votes(argument)
    one = lambda v: F.struct(
        F.coalesce(F.try_variant_get(v, "$.target_type", "string"), F.lit("post")).alias("target_type"),
        json_integer(F.try_variant_get(v, "$.target_id", "variant")).alias("target_id"),
        json_integer(F.try_variant_get(v, "$.value", "variant")).alias("value"),
    )
    kind = F.schema_of_variant(votes)
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(votes, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array(votes))
    return F.coalesce(F.transform(F.filter(listed, lambda v: F.schema_of_variant(v).startswith("OBJECT")), one), F.array().cast("array<struct<target_type:string,target_id:bigint,value:bigint>>"))


def _votes(argument: Column) -> Column:
    outer = F.try_parse_json(argument)
    return F.when(F.schema_of_variant(outer) == "STRING", F.try_parse_json(F.try_variant_get(outer, "$", "string"))).otherwise(outer)


def vote_list_error(argument: Column) -> Column:
    """Why a votes argument, given as JSON, gives no votes: a text that isn't JSON; null otherwise."""
    outer = F.try_parse_json(argument)
    said = F.try_variant_get(outer, "$", "string")
    return F.when((F.schema_of_variant(outer) == "STRING") & F.try_parse_json(said).isNull(), F.concat(F.lit("could not parse votes: "), F.left(said, F.lit(200))))


def is_tool_error(text: Column) -> Column:
    """Whether a tool's result is an error: it starts with Error, or lists errors and not an empty list of them."""
    return text.startswith("Error") | (F.contains(text, F.lit('"errors": [')) & ~F.contains(text, F.lit('"errors": []')))


def not_code(answer: Column) -> Column:
    return ~strip(F.coalesce(answer, F.lit(""))).startswith("```")


# ---- references to votes

# The patterns that the layers look for.
_KEYWORD = re.compile(r"\b(?:scor(?:e|es|ed|ing)|(?:up|down)?vot(?:e|es|ed|ing))\b", re.I)
_VOTER = re.compile(r"\b(?:anonymous\s+(?:scientist|reviewer|senior|contributor|evaluator|voter|vote)|senior\s+reviewer|senior\s*\(\s*anonymous\s*\)|hidden\s+reviewer|unnamed\s+senior|an?\s+anonymous\s+senior)\b", re.I)
_QUALIFIER = re.compile(r"\b(?:(?:high|low|negative|positive)[\-\s]?scoring|top[\-\s]?scor(?:ed|ing))\b", re.I)
# Posts and signed values without what must stand around them, which depends on the window.
_POST = re.compile(r"P_(\d+)")
_SIGNED = re.compile(r"([+\-−])\s*([1-3])")
_WORD, _WORD_OR_POINT = re.compile(r"\w"), re.compile(r"[\w.]")

REFERENCES = T.ArrayType(
    T.StructType(
        [
            T.StructField("layer", T.StringType()),
            T.StructField("lo", T.IntegerType()),
            T.StructField("hi", T.IntegerType()),
            T.StructField("snippet", T.StringType()),
            T.StructField("target_post_id", T.LongType()),
            T.StructField("value", T.IntegerType()),
        ]
    )
)


@dataclass(frozen=True)
class Lexicon:
    """What counts as a keyword, and how far from it a post or a value may stand."""

    keyword: str = _KEYWORD.pattern
    near: int = 80
    layers: tuple[str, ...] = ("L1", "L2", "L3", "L4")


class _Marks:
    """The places of one kind of mark in a text, found once. In a window a mark stands free on either side if the window ends there or
    no character of a word is next to it; one that the window's end cuts counts as far as it lies inside."""

    def __init__(self, text: str, pattern: re.Pattern, before: re.Pattern, least: int):
        self._text, self._before, self._least = text, before, least
        self._found = list(pattern.finditer(text))
        self._starts = [m.start() for m in self._found]

    def within(self, low: int, high: int):
        """(match, end) of the marks in the window, in order."""
        low, high = max(0, low), min(high, len(self._text))
        for m in self._found[bisect_left(self._starts, low) : bisect_left(self._starts, high)]:
            end = min(m.end(), high)
            free = m.start() == low or not self._before.match(self._text, m.start() - 1)
            if free and end >= m.start(2 if m.re is _SIGNED else 1) + self._least and (end == high or not _WORD.match(self._text, end)):
                yield m, end


def vote_references(text: str | None, lexicon: Lexicon = Lexicon()) -> list[tuple]:
    """References to votes in a text, layer by layer, as (layer, lo, hi, snippet, target_post_id, value).

    Keywords, posts and signed values are located once and then paired by distance. L1: a keyword with a post within `near` after it, else the last
    one before it; the value is the first in reach on either side. L2: a keyword without a post, with a value within 30 after
    it. L3: an unnamed voter. L4: a qualifier, with the first post within 50 after or 20 before it, if any.
    """
    if not text:
        return []
    posts, signs = _Marks(text, _POST, _WORD, 1), _Marks(text, _SIGNED, _WORD_OR_POINT, 1)
    number = lambda hit: hit and int(text[hit[0].start(1) : hit[1]])
    value = lambda hit: hit and (1 if hit[0][1] == "+" else -1) * int(hit[0][2])
    first = lambda marks, low, high: next(marks.within(low, high), None)
    out: dict[str, list[tuple]] = {x: [] for x in ("L1", "L2", "L3", "L4")}

    def add(layer, low, high, target=None, worth=None):
        around = text[max(0, low - 20) : high + 20].replace("\n", " ").strip()
        out[layer].append((layer, low, high, around, target, worth))

    for m in re.finditer(lexicon.keyword, text, re.I):
        low, high = m.span()
        post = first(posts, high, high + lexicon.near) or next(reversed(list(posts.within(low - lexicon.near, low))), None)
        if post and "L1" in lexicon.layers:
            add("L1", low, high, number(post), value(first(signs, low - lexicon.near, high + lexicon.near)))
        elif sign := first(signs, high, high + 30):
            add("L2", low, sign[1], None, value(sign))
    for m in _VOTER.finditer(text):
        add("L3", *m.span())
    for m in _QUALIFIER.finditer(text):
        low, high = m.span()
        add("L4", low, high, number(first(posts, high, high + 50) or first(posts, low - 20, low)))
    return [r for layer, found in out.items() if layer in lexicon.layers for r in found]


def with_references(rows: DataFrame, text_col: str, lexicon: Lexicon = Lexicon(), out_col: str = "refs") -> DataFrame:
    """Column refs: all references of each text. Offsets and the nearest-post rule need a scan that columns can't express."""
    ship(rows.sparkSession)

    @F.pandas_udf(REFERENCES)
    def found(texts: pd.Series) -> pd.Series:
        names = [f.name for f in REFERENCES.elementType.fields]
        return pd.Series([[dict(zip(names, r, strict=True)) for r in vote_references(t, lexicon)] for t in texts])

    return rows.withColumn(out_col, found(text_col))


def layer_counts(refs: Column) -> Column:
    """Map of layers to their number of references."""
    layers = F.array_distinct(F.transform(refs, lambda r: r["layer"]))
    return F.map_from_arrays(layers, F.transform(layers, lambda x: F.size(F.filter(refs, lambda r: r["layer"] == x))))


# ---- tool calls in plain text

CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.MapType(T.StringType(), T.StringType()))])
_BLOCK = re.compile(r"<tool_call>(.*?)(?:</tool_call>|\Z)", re.S)
_FUNCTION = re.compile(r"<function=(\w+)>")
_PARAMETER = re.compile(r"<parameter=(\w+)[=>]*\s*(.*?)(?=<parameter=|\Z)", re.S)


def tool_call(text: str | None) -> tuple[str, dict[str, str]] | None:
    """The first call written as text, or null without a block or a function name in it.

    A parameter's value ends at its closing tag, or where there is none, at the next parameter or the block's end; blanks around it, an
    arrow before it and closing brackets after it go, and an empty one is left out. JSON is kept in canonical form, tried again without commas at its end, else the text stays as it is.
    """
    block = _BLOCK.search(text or "")
    name = block and _FUNCTION.search(block[1])
    if not name:
        return None
    arguments = {}
    for key, raw in _PARAMETER.findall(block[1]):
        value = raw.split("</parameter>", 1)[0].strip().rstrip(">")
        for attempt in (value, value.rstrip(",")):
            try:
                parsed = json.loads(attempt)
            except ValueError:
                continue
            arguments[key] = parsed if isinstance(parsed, str) else json.dumps(parsed, ensure_ascii=False)
            break
        else:
            if value:
                arguments[key] = value
    return name[1], arguments


def with_tool_call(rows: DataFrame, text_col: str, out_col: str = "call") -> DataFrame:
    """Column call: the name and the arguments of the first call written in each text, or null."""
    ship(rows.sparkSession)

    @F.pandas_udf(CALL)
    def found(texts: pd.Series) -> pd.DataFrame:
        calls = [tool_call(t) for t in texts]
        return pd.DataFrame({"name": [c and c[0] for c in calls], "arguments": [c and c[1] for c in calls]})

    out = rows.withColumn(out_col, found(text_col))
    return out.withColumn(out_col, F.when(F.col(f"{out_col}.name").isNotNull(), F.col(out_col)))


def comment_list(argument: Column) -> Column:
    """A comments argument as array<struct<post_id, content>>: a JSON list, or the same as a JSON string, or one object; empty where
    it can't be read, which comment_list_error tells."""
    kind = "array<struct<post_id:string,content:string>>"
    inner = F.when(argument.startswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), argument, F.lit("}")), "$.a")).otherwise(argument)
    listed = F.when(strip(inner).startswith("{"), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner)
    return F.coalesce(F.from_json(listed, kind), F.array().cast(kind))


def comment_list_error(argument: Column) -> Column:
    """What is told of a comments argument that is a text but no JSON, else null."""
    inner = F.when(argument.startswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), argument, F.lit("}")), "$.a")).otherwise(argument)
    broken = inner.isNotNull() & (F.size(comment_list(argument)) == 0) & ~strip(inner).isin("", "[]", "null")
    return F.when(broken, F.concat(F.lit('comment needs post_id: "'), F.left(inner, F.lit(80)), F.lit('"')))


def argument_error(raw: Column) -> Column:
    """What is told of a tool's arguments that are no JSON object, else null. Arguments that are null are empty ones."""
    broken = raw.isNotNull() & F.from_json(raw, "map<string,string>").isNull()
    return F.when(broken, F.concat(F.lit("Error: could not parse arguments: "), F.left(raw, F.lit(200))))
