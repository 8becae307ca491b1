"""Personal data: base patterns, then lexical patterns learned from what they find.

Base spans are regular expressions with checks (Luhn, digit counts). Bootstrapping starts from them: they are the seed
entities. Every identifier-like run of one to four tokens that is no base span is a candidate *instance*. An instance and a
seed alike induce two *patterns*: the word before it with its coarse shape (runs of digits and letters, whatever their
length), and its exact shape (digits by their number) with the check that its digits pass, in any context. Over the corpus,
patterns and instances make a graph. In each of ``ROUNDS`` rounds, a pattern's confidence is the trust of its distinct
instances over their number and one more; an instance's trust is the best confidence of its patterns that at least ``SUPPORT``
trusted instances back. Patterns of confidence ``ACCEPT`` or more then mark their instances everywhere as spans of the
seeds' kind; where marked instances overlap, the first and then the longest stays.

So the contexts find what no expression describes (an address mistyped after "login from"), and the shapes what the
expressions lose (a card number or a phone number that runs into the number behind it), while numbers of a card's length
that fail its checksum stay unmarked.

All counts cover all documents. They are pre-aggregated before each shuffle, and the graph holds
digests of whole patterns and instances, not texts.

Defined cases: a null or empty text has no spans; repeated documents are scanned each, and a
repeated instance counts once for a pattern; rows with a null doc_id are kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
ACCEPT = 0.9
SUPPORT = 5
#: Accepted patterns are broadcast up to this many; beyond, they are joined.
MOST_PATTERNS = 100_000
#: Tokens of an instance, at most.
MOST_TOKENS = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST = re.compile(r"[^\x20\x09-\x0D]*")
_SPACE = frozenset(" \t\n\v\f\r")
_DIGITS = re.compile(r"[0-9]")
_MIXED = re.compile(r"(?=[^\W_]*+\Z)(?:[0-9]++[^\W\d_]++){2,}+[0-9]*+|(?=[^\W_]*+\Z)(?:[^\W\d_]++[0-9]++){2,}+[^\W\d_]*+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
_PLAIN = re.compile(r"[0-9()+.-]+")
_HEAD = re.compile(r"[A-Za-z_]++[=:]+[\"']?|[\"'\[{<]+")
_OPEN = frozenset("\"'([{<")
_CLOSE = ".,;:!?\"']}>%&*#$"

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: its run of local characters, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end) in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs of characters other than white space that hold a digit."""
    m = _DIGITS.search(text)
    while m:
        start = m.start()
        while start and text[start - 1] not in _SPACE:
            start -= 1
        end = _REST.match(text, m.start()).end()
        yield start, end
        m = _DIGITS.search(text, end)


def _shape(token: str) -> str:
    """Digits by their number, letters as one sign; a mixed run of at least four turns by its length."""
    if _MIXED.fullmatch(token):
        return f"m{len(token)}"
    return _RUN.sub(lambda m: f"9{len(m[0])}" if m[0][0] in "0123456789" else "a", token)


def _coarse(token: str) -> str:
    return "m" if _MIXED.fullmatch(token) else _RUN.sub(lambda m: "9" if m[0][0] in "0123456789" else "a", token)


def _checks(token: str) -> str:
    """Which checks of the kinds the digits pass."""
    digits = re.sub("[^0-9]", "", token)
    quad = token.split(".")
    flags = "l" if 14 <= len(digits) <= 19 and _luhn(digits) else ""
    flags += "p" if 10 <= len(digits) <= 15 else ""
    return flags + ("q" if len(quad) == 4 and all(x.isdigit() and x.isascii() and int(x[-3:]) <= 255 and len(x) <= 3 for x in quad) else "")


def _before(text: str, start: int) -> str:
    """What leads to a place, in lower case: a name with = or : that touches it, or else the word before, its digits as 0."""
    stop = start
    while stop and text[stop - 1] in _OPEN:
        stop -= 1
    first = stop
    if stop and text[stop - 1] not in _SPACE:
        while first and text[first - 1] in "=:":
            first -= 1
        while first and (text[first - 1].isalpha() or text[first - 1] == "_"):
            first -= 1
        return text[first:stop].lower()
    while first and text[first - 1] in _SPACE:
        first -= 1
    stop = first
    while first and text[first - 1] not in _SPACE:
        first -= 1
    return re.sub("[0-9]+", "0", text[first:stop].lower())


def _patterns(lead: str, token: str) -> tuple[str, str]:
    """The exact shape in any context, and the context with the coarse shape."""
    return f"shape {_checks(token)} {_shape(token)}", f"after {lead} {_coarse(token)}"


def instances(text: str, base: list[Span]) -> Iterator[tuple[int, int, tuple[str, str], str, int]]:
    """(start, end, patterns, instance, kind number or -1) of base spans and of the identifier-like runs of tokens outside them."""
    for a, kind, b in base:
        yield a, b, _patterns(_before(text, a), text[a:b]), text[a:b], kind
    k, last = 0, -1
    reach: list[list[int]] = []
    for a, _, b in base:  # spans merged into runs
        if a < last:
            reach[-1][1] = last = max(last, b)
        else:
            reach.append([a, last := b])
    run: list[tuple[int, int]] = []  # tokens one space apart that hold nothing but digits and the signs of numbers
    for a, b in _tokens(text):
        while k < len(reach) and reach[k][1] <= a:
            k += 1
        if k < len(reach) and reach[k][0] < b:
            run = []
            continue
        left = text[a:b].rstrip(_CLOSE)
        plain = bool(_PLAIN.fullmatch(left))
        if not (plain and run and run[-1][1] + 1 == a and text[run[-1][1]] == " "):
            run = []
        run = [*run[1 - MOST_TOKENS :], (a, a + len(left))] if plain else []
        if head := _HEAD.match(left):
            cut = head.end()
            lead = head[0].lower() if head[0][0].isalpha() else _before(text, a)
        else:
            cut, lead = 0, _before(text, a)
        if len(left) - cut >= 6 and _DIGITS.search(left, cut):
            yield a + cut, a + len(left), _patterns(lead, left[cut:]), left[cut:], -1
        for first, _ in run[:-1]:  # longer instances that end here
            token = text[first : a + len(left)]
            if len(token) >= 6:
                yield first, a + len(left), _patterns(_before(text, first), token), token, -1
        if len(left) != b - a:  # a sign behind ends the run
            run = []


def _edges(docs: DataFrame) -> DataFrame:
    """pattern, kind and instance (digests) of everything identifier-like, each once per batch of rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], int] = {}
        for text in batch.column(0):
            text = text.as_py()
            if text and (base := base_spans(text)) is not None:
                for *_, made, instance, kind in instances(text, base):
                    for pattern in made:
                        key = _digest(pattern), _digest(instance)
                        got[key] = max(kind, got.get(key, -1))
        if got:
            yield pa.record_batch([pa.array([k[0] for k in got]), pa.array([k[1] for k in got]), pa.array(list(got.values()), pa.int32())], names=["pattern", "instance", "kind"])

    return common.map_arrow(docs.select(F.col("text").cast("string")), run, "pattern long, instance long, kind int")


def _digest(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def patterns(docs: DataFrame) -> DataFrame:
    """pattern and kind (number) of the accepted patterns."""
    edges = _edges(docs).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    edges, path = common.materialize(edges, "pii-edges")
    trust = edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("trust"))
    old = None
    for _ in range(ROUNDS):
        scored = (
            edges.select("pattern", "instance")
            .join(trust, "instance", "left")
            .groupBy("pattern")
            .agg(F.count("*").alias("n"), F.sum("trust").alias("sure"), F.count("trust").alias("backers"), F.max("kind").alias("kind"), F.min("kind").alias("low"))
        )
        good = scored.where((F.col("backers") >= SUPPORT) & (F.col("kind") == F.col("low"))).select("pattern", "kind", (F.col("sure") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= ACCEPT)
        good, made = common.materialize(good, "pii-patterns")
        if old:
            common.discard(docs.sparkSession, old)
        old = made
        more = edges.where("kind < 0").select("pattern", "instance").join(good, "pattern").groupBy("instance").agg(F.max("kind").alias("kind"), F.max("score").alias("trust"))
        seeds = edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("trust"))
        trust = seeds.unionByName(more).groupBy("instance").agg(F.max("kind").alias("kind"), F.max("trust").alias("trust"))
    common.discard(docs.sparkSession, path)
    return good.select("pattern", "kind")


_SPANS = "array<struct<start:long,kind:int,end:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])


def _fields(spans: list[Span]) -> list[dict]:
    return [{"start": a, "kind": k, "end": b} for a, k, b in spans]


def _chosen(marked: list[Span]) -> list[Span]:
    """Of spans that overlap, the first, and of those the longest."""
    out, done = [], -1
    for a, k, b in sorted(marked, key=lambda s: (s[0], -s[2], s[1])):
        if a >= done:
            out.append((a, k, b))
            done = b
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (start, kind, end), those of ``spans`` with what the patterns added."""
    accepted = patterns(docs)
    first = accepted.limit(MOST_PATTERNS + 1).collect()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if len(first) > MOST_PATTERNS:
        return _found_by_join(rows, accepted)
    shared = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in first})

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, base, more = shared.value, [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base.append(own := base_spans(text))
            new = []
            for a, b, made, _, k in instances(text, own) if known else ():
                if k < 0:
                    new += [(a, known[d], b) for d in map(_digest, made) if d in known][:1]
            more.append(sorted(own + _chosen(new)))
        yield pa.record_batch([batch.column(0), pa.array(map(_fields, base), pa.list_(_SPAN)), pa.array(map(_fields, more), pa.list_(_SPAN))], names=["doc_id", "base", "spans"])

    return common.map_arrow(rows, run, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def _found_by_join(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """As ``find``, with patterns too many to broadcast: the instances meet them in a join."""
    drawn = pa.list_(pa.struct([("start", pa.int64()), ("nth", pa.int32()), ("end", pa.int64()), ("pattern", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base, more = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base.append(own := base_spans(text))
            more.append([{"start": a, "nth": n, "end": b, "pattern": _digest(p)} for a, b, made, _, k in instances(text, own) if k < 0 for n, p in enumerate(made)])
        yield pa.record_batch([batch.column(0), pa.array(map(_fields, base), pa.list_(_SPAN)), pa.array(more, drawn)], names=["doc_id", "base", "more"])

    made = common.map_arrow(rows, run, f"doc_id long, base {_SPANS}, more array<struct<start:long,nth:int,end:long,pattern:long>>")
    found, _ = common.materialize(made.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    each = found.select("row", F.explode("more").alias("m")).select("row", "m.start", "m.nth", "m.end", "m.pattern").join(accepted, "pattern")
    each = each.groupBy("row", "start", "end").agg(F.min(F.struct("nth", "kind")).alias("k")).select("row", "start", F.col("k.kind").alias("kind"), "end")
    gained = each.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("gained"))

    def choose(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = []
        for own, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own, new = ([(x["start"], x["kind"], x["end"]) for x in part or ()] for part in (own, new))
            spans.append(_fields(sorted(own + _chosen(new))))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "base", "spans"])

    return common.map_arrow(found.join(gained, "row", "left").select("doc_id", "base", "gained"), choose, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def _joined(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
