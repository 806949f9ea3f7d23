"""The filterable search language: parsed in Python, run as one Column predicate.

    a b            both words                 "a b"        a phrase
    -a  NOT a      not the word               a OR b  a | b   either
    a AND b  &     both                       a XOR b  ^   exactly one
    ( )            grouping                   a* a?b       wildcards within a word
    in:#c,#d       in one of the channels     -in:#c       in none
    from:@u        by a user                  has:link     holds a link (star, pin, reaction: columns)
    before:/after:/on:/during: dates, months and years

Words match whole words, case does not count. Operator words are in capitals. Adjacent terms are joined by AND,
which binds closer than XOR, and that closer than OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s*(?:(-)?"([^"]*)"|([()])|(&&?|\|\|?|\^|!)|([^\s()"]+))')
FILTER = re.compile(r"(-)?(in|from|has|before|after|on|during):(.+)", re.S)


@dataclass(frozen=True)
class Fields:
    """Columns the predicate reads."""

    text: str = "text"
    channel: str = "channel"
    user: str = "user"
    date: str = "date"

    def words(self, parts: list[str]) -> Column:
        """Whether the text has these words in a row; an index may answer this instead (index/text.py)."""
        return F.coalesce(F.lower(F.col(self.text)).rlike(pattern(parts)), F.lit(False))


def parse(query: str, fields: Fields = Fields()) -> Column:
    """The predicate of a query; raises ValueError where the grammar does not fit. An empty query matches all."""
    tokens = _tokens(query)
    if not tokens:
        return F.lit(True)
    column, at = _either(tokens, 0, fields)
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]} in {query!r}")
    return column


def _tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m:
            raise ValueError(f"cannot read {query[at:]!r}")
        minus, phrase, paren, sign, word = m.groups()
        if phrase is not None:
            out += [("op", "NOT")] * bool(minus) + [("phrase", phrase)]
        elif paren:
            out.append(("paren", paren))
        elif sign:
            out.append(("op", {"&": "AND", "|": "OR", "^": "XOR", "!": "NOT"}[sign[0]]))
        elif word in ("AND", "OR", "XOR", "NOT"):
            out.append(("op", word))
        elif word.startswith("-") and len(word) > 1 and not FILTER.fullmatch(word):
            out += [("op", "NOT"), ("word", word[1:])]
        elif word == "+":
            out.append(("op", "AND"))
        else:
            out.append(("word", word.lstrip("+")))
        at = m.end()
    return out


def _either(tokens, at, fields):
    left, at = _one_of(tokens, at, fields)
    while at < len(tokens) and tokens[at] == ("op", "OR"):
        right, at = _one_of(tokens, at + 1, fields)
        left = left | right
    return left, at


def _one_of(tokens, at, fields):
    left, at = _all_of(tokens, at, fields)
    while at < len(tokens) and tokens[at] == ("op", "XOR"):
        right, at = _all_of(tokens, at + 1, fields)
        left = (left & ~right) | (~left & right)
    return left, at


def _all_of(tokens, at, fields):
    left, at = _single(tokens, at, fields)
    while at < len(tokens) and tokens[at] not in (("op", "OR"), ("op", "XOR"), ("paren", ")")):
        at += tokens[at] == ("op", "AND")
        right, at = _single(tokens, at, fields)
        left = left & right
    return left, at


def _single(tokens, at, fields):
    if at >= len(tokens):
        raise ValueError("the query ends too soon")
    kind, value = tokens[at]
    if (kind, value) == ("op", "NOT"):
        inner, at = _single(tokens, at + 1, fields)
        return ~inner, at
    if (kind, value) == ("paren", "("):
        inner, at = _either(tokens, at + 1, fields)
        if at >= len(tokens) or tokens[at] != ("paren", ")"):
            raise ValueError("a parenthesis is not closed")
        return inner, at + 1
    if kind == "phrase":
        return _words(value.split(), fields), at + 1
    if kind == "word":
        m = FILTER.fullmatch(value)
        return (_filter(*m.groups(), fields) if m else _words([value], fields)), at + 1
    raise ValueError(f"unexpected {value!r}")


def _words(parts: list[str], fields: Fields) -> Column:
    """Whole words in a row; * and ? stand for word characters."""
    if not parts:
        return F.lit(True)
    return fields.words(parts)


def pattern(parts: list[str]) -> str:
    one = lambda p: "".join(r"\w*" if c == "*" else r"\w" if c == "?" else re.escape(c) for c in p.lower())
    return r"(?<![\w])" + r"\W+".join(map(one, parts)) + r"(?![\w])"


def _filter(minus, name, value, fields: Fields) -> Column:
    values = [v.lstrip("#@") for v in value.split(",") if v.strip("#@")]
    if name == "in":
        found = F.col(fields.channel).isin(values)
    elif name == "from":
        found = F.col(fields.user).isin(values)
    elif name == "has":
        found = F.col(fields.text).rlike(r"https?://\S") if values == ["link"] else F.col(f"has_{values[0]}")
    else:
        low, high = _span(value)
        date = F.col(fields.date)
        found = {"before": date < low, "after": date >= high, "on": (date >= low) & (date < high), "during": (date >= low) & (date < high)}[name]
    found = F.coalesce(found, F.lit(False))
    return ~found if minus else found


def _span(value: str) -> tuple[Column, Column]:
    """The days that a date, month or year covers: from, to (exclusive)."""
    parts = value.split("-")
    first = F.to_date(F.lit("-".join([*parts, "01", "01"][:3])))
    return first, {1: F.add_months(first, 12), 2: F.add_months(first, 1), 3: F.date_add(first, 1)}[len(parts)]


def search(messages: DataFrame, query: str, fields: Fields = Fields()) -> DataFrame:
    return messages.where(parse(query, fields))


def page(found: DataFrame, order: list[Column], count: int = 100, number: int = 1) -> DataFrame:
    """One page of an ordered result: a global limit, so the sort keeps no more than the pages up to it."""
    if not 1 <= count <= 100 or not 1 <= number <= 100:
        raise ValueError("count and page go from 1 to 100")
    return found.orderBy(*order).offset((number - 1) * count).limit(count)


def pages(found: DataFrame, key: str, order: list[Column], count: int = 100) -> DataFrame:
    """Every result of each key with its page and place."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return found.withColumn("place", n.cast("bigint")).withColumn("page", F.floor((n - 1) / count).cast("bigint") + 1)


def relevance(query: str, text: Column) -> Column:
    """How often the query's plain words and phrases stand in a text: the score that results are sorted by."""
    plain = [value for kind, value in _tokens(query) if kind in ("word", "phrase") and value.strip() and not FILTER.fullmatch(value)]
    found = [F.regexp_count(F.lower(text), F.lit(pattern(p.split()))) for p in plain]
    return sum(found, F.lit(0)).cast("bigint")


SORTS = {"score": "score", "timestamp": "timestamp"}


def _result(found: DataFrame, query: str, kind: str, fields: Fields) -> DataFrame:
    return found.select("*", relevance(query, F.col(fields.text)).alias("score"), F.lit(kind).alias("match_type"))


def _sorted_page(found: DataFrame, sort: str, sort_dir: str, tie: list[str], count: int, number: int) -> DataFrame:
    if sort not in SORTS or sort_dir not in ("asc", "desc"):
        raise ValueError("sort by score or timestamp, asc or desc")
    key = F.col(SORTS[sort])
    return page(found, [key.desc() if sort_dir == "desc" else key.asc(), *tie], count, number)


def search_messages(messages: DataFrame, query: str, tie: list[str], sort: str = "score", sort_dir: str = "desc", count: int = 20, number: int = 1, fields: Fields = Fields()) -> DataFrame:
    """One page of the messages that the query finds, with score and match_type."""
    return _sorted_page(_result(search(messages, query, fields), query, "message", fields), sort, sort_dir, tie, count, number)


def search_files(files: DataFrame, query: str, tie: list[str], sort: str = "score", sort_dir: str = "desc", count: int = 20, number: int = 1, fields: Fields = Fields(text="name")) -> DataFrame:
    """The same of files, by their names."""
    return _sorted_page(_result(search(files, query, fields), query, "file", fields), sort, sort_dir, tie, count, number)


def search_all(messages: DataFrame, files: DataFrame, query: str, message_tie: list[str], file_tie: list[str], **options) -> DataFrame:
    """A page of messages and a page of files in one bag; columns of one kind are null in the other."""
    found = search_messages(messages, query, message_tie, **options)
    return found.unionByName(search_files(files, query, file_tie, **options), allowMissingColumns=True)
