"""Personal data by bootstrapped contextual extraction.

Spans of fixed shape (mail and network addresses, card and phone numbers) are the seeds, and long strings of mixed letters and digits those of a
fifth kind, secrets, which count only as evidence. What stands around a span are lexical patterns: two words before it, the words on both sides, the
label that it is the value of (`password=...`). A pattern's slot takes any word with a digit or an @, any longer number and any labelled
value, letters included. Spark joins patterns and instances as a graph and scores them in turns, until nothing changes: a pattern is trusted
for a kind by how many different known instances it extracts and by their share of all it extracts; an instance becomes known if the
trusted patterns that extract it make it likely enough together. What trusted patterns extract beyond the seeds is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstselect.llm.common import clear_of, pin, row_mark, slices, tidy

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Different known instances that a trusted pattern has at least, their least share of all its instances, and the probability from which an instance is known.
LEAST_INSTANCES = 5
TRUST = 0.5
ACCEPTED = 0.75
SEED_CHARS = 16
WORD_CHARS = 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+")
_MARKED = re.compile(r"[^\s0-9@]*[0-9@]\S*")
_LABELLED = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]{0,40})[\"']?[\x20\t]{0,2}[=:][\x20\t]{0,2}[\"']?([^\s\"'<>,;=]+)")
_LABEL = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]{0,40})[\"']?[\x20\t]{0,2}[=:][\x20\t]{0,2}[\"']?\Z")
_ANY = re.compile(r"[0-9@]")
_VALUES = re.compile(r"[0-9@=:]")
_EDGE = ".,;:!?\"'()[]{}<>|*#="

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; what stands before an @ is looked at once, so long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots; in a longer run every four are a match of their own. Matches with a part over 255 are dropped."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of fixed shape, by kind and then by start, in code points, the end exclusive."""
    if not _ANY.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    out += [("ip", a, b) for a, b in addresses(text)]
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def is_seed_secret(instance: str) -> bool:
    """Whether a string is long and mixes letters and digits, as keys and tokens do."""
    plain = instance.replace("_", "").replace("-", "")
    digits = sum(c.isdigit() for c in plain)
    return len(plain) >= SEED_CHARS and plain.isalnum() and plain.isascii() and digits >= 3 and len(plain) - digits >= 3


def _words(text: str, at: int, count: int, ahead: bool) -> list[str]:
    """Up to ``count`` lower-cased words before, or behind, a place, whole ones however long; of longer ones than WORD_CHARS a hash."""
    reach = 64
    while True:
        low, high = (at, min(len(text), at + reach)) if ahead else (max(0, at - reach), at)
        words = text[low:high].lower().split()
        # The outermost word may be cut, unless the text ends there.
        if (high == len(text) if ahead else low == 0) or len(words) > count:
            words = words[:count] if ahead else words[-count:]
            return [w if len(w) <= WORD_CHARS else "#" + xxhash.xxh64_hexdigest(w) for w in words]
        reach *= 4


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: two words before it; the word before and the one behind it; the label whose value it is."""
    before, after = _words(text, start, 2, False), _words(text, end, 1, True)
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if label := _LABEL.search(text, max(0, start - 50), start):
        out.append(f"{label[1].lower()}= _")
    return out


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Other spans that a pattern may extract: labelled values, numbers of six digits or more, words with a digit or an @; clear of ``taken`` and each other."""
    found = [m.span(2) for m in _LABELLED.finditer(text)]
    found += [m.span() for m in _NUMBER.finditer(text) if sum(c.isdigit() for c in m.group()) >= 6]
    found += [m.span() for m in _MARKED.finditer(text)]
    busy, out = sorted((a, b) for _, a, b in taken), []
    for a, b in found:
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        i = bisect_left(busy, (a, b))
        if b - a >= 3 and (i == 0 or busy[i - 1][1] <= a) and (i == len(busy) or busy[i][0] >= b):
            busy.insert(i, (a, b))
            out.append((a, b))
    return sorted(out)


SPAN = "array<struct<kind: string, start: int, end: int>>"
SEEN = "array<struct<kind: string, start: int, end: int, instance: string, patterns: array<string>>>"


def seen(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``base`` (its spans of fixed shape) and ``seen`` (these and other candidates in context)."""
    rest = [c for c in docs.columns if c != text]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]
    more = pa.list_(pa.struct(fields))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bases, others = [], []
        for t in part.column(text).to_pylist():
            t = t or ""
            base = base_spans(t)
            around = []
            if base or _VALUES.search(t):
                others_here = ((SECRET if is_seed_secret(t[a:b]) else None, a, b) for a, b in candidates(t, base))
                for kind, a, b in [*base, *others_here]:
                    x = t[a:b].lower()
                    x = x if len(x) <= 4 * WORD_CHARS else "#" + xxhash.xxh64_hexdigest(x)
                    around.append({"kind": kind, "start": a, "end": b, "instance": x, "patterns": patterns(t, a, b)})
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            others.append(around)
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in rest), pa.array(bases, span), pa.array(others, more)], [*rest, "base", "seen"]
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield work(part)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(tidy(over), ", ".join([*kinds, f"base {SPAN}", f"seen {SEEN}"]))


def bootstrap(found: DataFrame, least: int = LEAST_INSTANCES, trust: float = TRUST, accepted: float = ACCEPTED) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (instance, kind): what is trusted and known from spans ``found`` (kind, instance, pattern), seeds with a kind.

    Counts are over different instances, so copies of a document don't make a pattern better. The confidence is the share of known instances among
    all that the pattern extracts and one more; an instance is known if patterns trusted for a kind are not all wrong about it with the
    probability ``accepted``. Known instances are never given up, so the turns end: when one finds nothing new.
    """
    kinds = (*KINDS, SECRET)
    links = pin(found.select("pattern", "instance").distinct())
    known = pin(found.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")))
    while True:
        scored = links.join(known, "instance", "left")
        counts = scored.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])
        best = F.greatest(*[F.struct(F.col(k).alias("m"), F.lit(k).alias("kind")) for k in kinds])
        trusted = pin(
            counts.withColumn("best", best)
            .where((F.col("best.m") >= least) & (F.col("best.m") >= trust * F.col("n")))
            .select("pattern", F.col("best.kind").alias("kind"), (F.col("best.m") / (F.col("n") + 1)).alias("confidence"))
        )
        unknown = links.join(trusted, "pattern").join(known.select("instance"), "instance", "left_anti")
        likely = unknown.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("p"))
        fresh = pin(likely.where(F.col("p") >= accepted).groupBy("instance").agg(F.max_by("kind", F.struct("p", "kind")).alias("kind")))
        if fresh.isEmpty():
            return trusted, known
        known = pin(known.unionByName(fresh))


def find_private(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, ``base`` (spans of fixed shape) and ``spans`` (these and the ones found by context), and ``carry``.

    Spans are (kind, start, end) in code points, the end exclusive, by kind as listed in KINDS, secrets last, and then by start. Null and empty texts
    have none; repeated rows have the same ones; an empty table gives no rows. Spans found by context overlap neither base ones nor each other.
    Texts may be of any length, and so may words: the neighbours of a span are whole words. A carried column may have any name but base and spans.
    """
    carry = [c for c in carry or [] if c != "doc_id"]
    names = [f"carried_{i}" for i in range(len(carry))]
    docs = docs.select("doc_id", *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(f"`{text}`").alias("text"))
    rows = pin(seen(docs.withColumn("rid", F.monotonically_increasing_id()), "text"))
    each = rows.where(F.size("seen") > 0).select("rid", F.explode("seen").alias("s")).select("rid", "s.*")
    found = each.select("rid", "kind", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    trusted, known = bootstrap(found)
    beyond = found.where((F.col("kind").isNull()) | (F.col("kind") == SECRET)).drop("kind")
    more = beyond.join(trusted, "pattern").join(known, ["instance", "kind"]).select("rid", "start", "end", "kind").distinct()
    more = more.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, SECRET)) for x in (F.lit(k), F.lit(i))])
    ranked = lambda s: F.struct(rank[s["kind"]].alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))
    out = rows.join(more, "rid", "left").withColumn("all", F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    ordered = F.array_sort(F.transform("all", ranked))
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("start"), s["b"].alias("end")))
    return out.select("doc_id", "base", spans.alias("spans"), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)])


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of spans that overlap the first gives the name."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, every row and column, with personal data in the text replaced by its kind in brackets. Null text stays null."""
    names = docs.columns
    mark, key, more = clear_of(names, "mark"), clear_of(names, "key"), clear_of(names, "more")
    found = find_private(docs.select("doc_id", F.col(text).alias("text")).withColumn("mark", row_mark("text")), "text", ["mark"])
    # Rows whose spans all come from their shape need nothing but their text; only the others travel.
    extra = found.where(F.size("spans") > F.size("base")).dropDuplicates(["doc_id", "mark"])
    extra = extra.select(F.col("doc_id").alias(key), F.col("mark").alias(mark + "r"), F.col("spans").alias(more))
    met = docs.withColumn(mark, row_mark(text)).join(
        extra, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(mark + "r")), "left"
    )
    met = met.select(*[F.col(f"`{c}`") for c in names], more)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                new = []
                for t, spans in zip(part.column(text).to_pylist(), part.column(more).to_pylist(), strict=True):
                    own = [(s["kind"], s["start"], s["end"]) for s in spans] if spans else base_spans(t or "")
                    new.append(mask(t, own) if t and own else t)
                columns = [pa.array(new, pa.string()) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return met.mapInArrow(tidy(over), T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields]))
