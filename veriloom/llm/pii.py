"""Personal data by seeds and bootstrapped contextual patterns.

Seeds are the fixed forms (email, ip, card, phone) and keys, long random runs of letters and digits. What stands right
before and after a seed on its line induces lexical patterns; the same patterns also stand beside other tokens. Spark
scores the graph of patterns and instances for a few rounds: a pattern by the log-odds of its instances that are known or
believed against those that are not and against all ordinary words that it stands beside, an instance by its best
pattern. What is believed in one round is a seed of the next, so patterns that no seed stands beside are found too.
Patterns of high confidence and enough different seeds then mark identifiers of unknown form, with the kind ``id``.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import fresh, in_arrow, maybe_broadcast, only, staged

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 8
CONFIDENT = 0.85
LEAST_LENGTH = 6
#: How much a value of an identifier's shape that nothing else is known of counts against a pattern; an ordinary word
#: counts whole.
UNKNOWN = 0.15
#: A key is a run of letters and digits of such a length, with so many of each.
KEY_LENGTH, KEY_EACH = 20, 4
#: A word is frequent if such a share of the texts has it elsewhere than before a seed or candidate.
FREQUENT = 0.05
#: Words that a task counts before it hands them on.
COUNTED = 1 << 17
#: One in so many texts is read first for patterns that stand beside too many ordinary words already there.
FIRST = 128
#: Bytes of patterns that go to the tasks as they are, and number of patterns that go as checksums.
LISTED, CHECKED = 4 << 20, 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9_+/.@-]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from each ``@`` outwards: linear on any text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    double = str.maketrans("0123456789", "0246813579")
    return sum(map(int, digits[-1::-2] + digits[-2::-2].translate(double))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed forms: by kind as listed, then by start, in code points."""
    found = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


_PIECE = re.compile(r"\w+|[^\w\s]")
#: A context of over 100 characters has a word of so many, as it has three words or signs at most.
_LONG = re.compile(r"\w{30,}")
_KEY = re.compile(rf"[A-Za-z0-9]{{{KEY_LENGTH},}}")
_INNER = re.compile(r"[a-z0-9][A-Z]|[A-Za-z0-9][_+/@.-][A-Za-z0-9]")
_MARK = re.compile(r"[0-9A-Z_+/@.-]")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_WORD_CHARS = _LOCAL - frozenset("._%+-")
_TOKEN_CHARS = _WORD_CHARS | frozenset("_+/.@-")
LEFT, RIGHT = 3, 2
#: Characters a token, below which a text's words and signs are listed once for all its tokens.
SPARSE = 200


@functools.lru_cache(1 << 14)
def _normal(context: str) -> str:
    """Lower case, digits as 9, white space as one space; what is very long by its digest."""
    edge = (context[:1].isspace() and " " or ""), (context[-1:].isspace() and " " or "")
    short = edge[0] + " ".join(_DIGIT.sub("9", context.lower()).split()) + edge[1]
    return short if len(short) <= 100 else "#" + hashlib.md5(short.encode("utf-8", "surrogatepass")).hexdigest()


def _before(text: str, at: int) -> list[int]:
    """Where the last words and signs before ``at`` on its line begin, the nearest first. Only so much of the line is looked
    at as they need, so a line of many tokens takes linear time."""
    size = 64
    while True:
        lo = max(0, at - size)
        cut = text.rfind("\n", lo, at) + 1
        found = [m.start() for m in _PIECE.finditer(text, max(lo, cut), at)]
        if cut or not lo or len(found) > LEFT:  # the first of a cut line may be a part of a word
            return found[::-1][:LEFT]
        size *= 4


def _after(text: str, at: int) -> list[int]:
    """Where the next words and signs after ``at`` on its line end."""
    out: list[int] = []
    for m in _PIECE.finditer(text, at):
        if text.find("\n", out[-1] if out else at, m.start()) >= 0:
            break
        out.append(m.end())
        if len(out) == RIGHT:
            break
    return out


def _neighbours(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[list[int], list[int]]]:
    """:func:`_before` and :func:`_after` of every token; where tokens are dense, from one list of all words and signs."""
    if len(tokens) * SPARSE < len(text):
        yield from ((_before(text, b), _after(text, e)) for b, e in tokens)
        return
    pieces = [m.span() for m in _PIECE.finditer(text)]
    starts, ends = [p[0] for p in pieces], [p[1] for p in pieces]
    lines = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
    for b, e in tokens:
        i, j = bisect_left(starts, b), bisect_right(ends, e)
        begin, end = lines[bisect_left(lines, b) - 1], lines[bisect_left(lines, e)]
        yield [s for s in starts[max(0, i - LEFT) : i][::-1] if s > begin], [x for x in ends[j : j + RIGHT] if x <= end]


def _contexts(text: str, tokens: list[tuple[int, int]]) -> Iterator[list[str]]:
    """The patterns of each token: one to three words or signs before it and one or two after it, on its line."""
    for (begin, end), (before, after) in zip(tokens, _neighbours(text, tokens)):
        yield [f"l{n}|{_normal(text[at:begin])}" for n, at in enumerate(before, 1)] + [f"r{n}|{_normal(text[end:at])}" for n, at in enumerate(after, 1)]


def _shaped(value: str) -> bool:
    """Whether a token may be an identifier: of some length, with a digit, or with signs or capitals inside."""
    return len(value) >= LEAST_LENGTH and bool(_DIGIT.search(value) or len(value) >= 8 and _INNER.search(value))


def is_key(value: str) -> bool:
    """Whether a token is a long run of mixed letters and digits, as no word is."""
    for m in _KEY.finditer(value):
        digits = len(_DIGIT.findall(m[0]))
        if min(digits, len(m[0]) - digits) >= KEY_EACH and len(set(m[0])) >= 8:
            return True
    return False


def _free(tokens: Iterable[tuple[int, int]], spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Of ascending tokens those that overlap no span of a fixed form."""
    taken = sorted((b, e) for _, b, e in spans)
    k, last = 0, 0  # spans of several kinds may overlap, so the furthest end counts
    for begin, end in tokens:
        while k < len(taken) and taken[k][0] < end:
            last = max(last, taken[k][1])
            k += 1
        if last <= begin:
            yield begin, end


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """All tokens, without closing punctuation."""
    for m in _TOKEN.finditer(text):
        end = m.start() + len(m[0].rstrip(".@/+-"))
        if end > m.start():
            yield m.start(), end


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """The tokens with a digit, or with a sign or capital inside, found from those outwards."""
    last = 0
    for m in _MARK.finditer(text):
        begin = m.start()
        # a capital counts after a small letter or digit, a sign between letters or digits
        if begin >= last and (m[0].isdigit() or begin > last and text[begin - 1] in (_PLAIN if m[0].isalpha() else _WORD_CHARS) and (m[0].isalpha() or text[begin + 1 : begin + 2] in _WORD_CHARS)):
            while begin > last and text[begin - 1] in _TOKEN_CHARS:
                begin -= 1
            last = _TOKEN.match(text, begin).end()
            yield begin, begin + len(text[begin:last].rstrip(".@/+-"))


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens of an identifier's shape that overlap no span of a fixed form."""
    return [(b, e) for b, e in _free(_marked(text), spans) if e - b >= LEAST_LENGTH and _shaped(text[b:e])]


def _spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed forms by kind, then candidates, those that are keys with the kind ``key``."""
    base = base_spans(text)
    return base + [("key" if is_key(text[b:e]) else "", b, e) for b, e in candidates(text, base)]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("patterns", pa.list_(pa.string()))]))
SCANNED = "row long, doc_id long, text_hash string, spans array<struct<kind:string,start:long,end:long,value:long,patterns:array<string>>>"


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for b in batches:
        spans, hashes, rows = [], [], []
        for x in b.column(1):
            text = x.as_py() or ""
            every = _spans(text)
            beside = _contexts(text, [(s, e) for _, s, e in every])
            spans.append([{"kind": k, "start": s, "end": e, "value": _hash(text[s:e]), "patterns": p} for (k, s, e), p in zip(every, beside)])
            hashes.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() if any(k not in KINDS for k, _, _ in every) else None)
            rows.append(row)
            row += 1
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0), pa.array(hashes, pa.string()), pa.array(spans, _SPAN)], ["row", "doc_id", "text_hash", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """Spans of fixed forms and candidate tokens of every row, staged once."""
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return staged(docs.transform(in_arrow, _scan, SCANNED), "spans")


def _lower(text: str) -> str:
    return _DIGIT.sub("9", text.lower()) if _DIGIT.search(text) else text.lower()


def _elsewhere(text: str) -> set[str]:
    """The words and signs of a text that don't only stand beside its spans, as in patterns."""
    parts, at = [], 0
    spans = sorted((b, e) for _, b, e in _spans(text))
    for (begin, end), (left, right) in zip(spans, _neighbours(text, spans)):
        parts.append(text[at : left[-1] if left else begin])
        at = max(at, right[-1] if right else end)
    parts.append(text[at:])
    return set(_PIECE.findall(_lower("\n".join(parts))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[str] = Counter()

    def put() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
        n.clear()
        return out

    for b in batches:
        for x in b.column(0):
            n.update(_elsewhere(x.as_py() or ""))
            if len(n) > COUNTED:
                yield put()
    yield put()


def frequent_words(docs: DataFrame, share: float = FREQUENT) -> list[str]:
    """Words and signs that at least ``share`` of the texts have elsewhere than beside spans: at most the mean number of
    words of a text over ``share``."""
    least = max(1.0, share * docs.where("text is not null").count())
    counted = only(docs, "text").transform(in_arrow, _counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r.word for r in counted.where(F.col("n") >= least).select("word").collect())


def _pattern_words(pattern: str) -> list[str]:
    return _PIECE.findall(pattern.partition("|")[2])


def _checksum(pattern: str) -> int:
    """What Spark's ``crc32`` makes of a pattern."""
    return zlib.crc32(pattern.encode("utf-8", "surrogatepass"))


def _marks(wanted: Iterable[str], frequent: frozenset[str]) -> dict[str, bool]:
    """Words, none of them frequent, of which each occurrence of a pattern holds one: that of its words that most patterns
    share, and of these the longest, so that many patterns have few marks. True for those that may be a part of a word, as the
    one right beside a token can be."""
    words = []
    for p in wanted:
        side, _, context = p.partition("|")
        own = [(w, False) for w in _pattern_words(p)]
        at = -1 if side[0] == "l" else 0
        if context[at].isalnum():
            own[at] = own[at][0], True
        words.append({w for w in own if w[0] not in frequent})
    n = Counter(w for one in words for w, _ in one)
    marks: dict[str, bool] = {}
    for one in words:
        mark, part = max(one, key=lambda w: (n[w[0]], len(w[0]), w))
        marks[mark] = marks.get(mark, False) or part
    return marks


def _digested(pattern: str) -> bool:
    """Whether a pattern is the digest of a long context (see :func:`_normal`)."""
    return len(pattern) == 36 and pattern[3] == "#"


def _ordinary(wanted: frozenset[str] | None, frequent: frozenset[str], checksums: frozenset[int] | None = None):
    """(pattern, hash of an ordinary token that it stands beside), for the ``wanted`` patterns; else for those with one of the
    ``checksums``; else for all but those of frequent words."""
    marks = None if wanted is None else _marks((p for p in wanted if not _digested(p)), frequent)
    long = wanted is not None and any(map(_digested, wanted))
    whole = {m for m, part in marks.items() if not part} if marks else set()

    def asked(pattern: str) -> bool:
        if wanted is not None:
            return pattern in wanted
        if checksums is not None:
            return _checksum(pattern) in checksums
        return not frequent.issuperset(_pattern_words(pattern))

    def near(text: str) -> Iterable[tuple[int, int]]:
        """Tokens of a text; where marks are known, those around them at least."""
        low = _lower(text)
        if marks is None or len(low) != len(text):
            return _tokens(text)
        here = whole if len(whole) <= 32 else whole.intersection(_PIECE.findall(low))
        places = [m.span() for m in _LONG.finditer(low)] if long else []
        for m in (m for some in (here, marks.keys() - whole) for m in some if m in low):
            at = low.find(m)
            while at >= 0:
                end = at + len(m)
                if marks[m] or not (m[0].isalnum() and (low[max(0, at - 1) : at].isalnum() or low[end : end + 1].isalnum())):
                    places.append((at, end))
                at = low.find(m, end)
        out = set()
        for at, end in places:
            before = _before(text, at)
            lo = before[-1] if before else at
            while lo > 0 and text[lo - 1] in _TOKEN_CHARS:
                lo -= 1
            hi = next(islice((p.end() for p in _PIECE.finditer(text, end)), LEFT, None), len(text))
            hi = _TOKEN.match(text, hi - 1).end() if text[hi - 1] in _TOKEN_CHARS else hi
            out.update((t.start(), t.start() + len(t[0].rstrip(".@/+-"))) for t in _TOKEN.finditer(text, lo, hi))
        return sorted(t for t in out if t[1] > t[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, int]] = set()
            for x in b.column(0):
                text = x.as_py() or ""
                tokens = near(text)
                plain = [(s, e) for s, e in _free(tokens, base_spans(text)) if not _shaped(text[s:e])] if tokens else []
                if plain:
                    for (s, e), beside in zip(plain, _contexts(text, plain)):
                        value = _hash(text[s:e].lower())
                        found.update((p, value) for p in beside if asked(p))
            cols = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["pattern", "value"])

    return run


def _beside(texts: DataFrame, wanted: DataFrame, frequent: list[str]) -> DataFrame:
    """``pattern, value``: the ordinary tokens that each of the ``wanted`` patterns stands beside, as hashes, with repeats. Texts
    meet the patterns in the tasks that read them while the patterns are few (4 MB), and their checksums while these are; what
    passes the checksums, or else the patterns of all texts, is joined with them."""
    n, size = wanted.agg(F.count("*"), F.sum(F.octet_length("pattern") + 100)).first()
    few = (size or 0) <= LISTED
    listed = frozenset(r.pattern for r in wanted.select("pattern").collect()) if few else None
    checksums = frozenset(r.c for r in wanted.select(F.crc32(F.col("pattern").cast("binary")).alias("c")).collect()) if not few and n <= CHECKED else None
    seen = texts.transform(in_arrow, _ordinary(listed, frozenset(frequent), checksums), "pattern string, value long")
    return seen if few else seen.join(wanted.select("pattern"), "pattern", "left_semi")


def _texts(docs: DataFrame) -> DataFrame:
    return only(docs, "text").where("text is not null")


def possible(docs: DataFrame, wanted: DataFrame, frequent: list[str], confident: float = CONFIDENT, first: int = FIRST) -> DataFrame:
    """Of ``wanted(pattern, n)``, with the number of values of each, the patterns that may reach ``confident``: all values
    believed, and no ordinary token but those of one text in ``first``.

    All texts have these tokens and more, so what is left out here would fail there as well, by a quarter more and three,
    where a sketch's count errs by a few hundredths. The number of patterns grows with that of texts, and nearly all are of
    words that stand beside far too many ordinary ones; without this, each of them would be looked for in all texts.
    """
    some = _texts(docs).where(F.pmod(F.xxhash64("text"), F.lit(first)) == 0)
    there = _beside(some, wanted, frequent).groupBy("pattern").agg(F.count_distinct("value").alias("there"))
    most = (F.col("n") + 0.5) * (1 - confident) / confident - 0.5
    return wanted.join(there, "pattern", "left").where(F.coalesce("there", F.lit(0)) <= 1.25 * most + 3).select("pattern")


def ordinary(docs: DataFrame, wanted: DataFrame, frequent: list[str]) -> DataFrame:
    """``pattern, ordinary``: beside how many different ordinary tokens each of the ``wanted`` patterns stands (a sketch's
    count, so that nothing is shuffled but sketches)."""
    return _beside(_texts(docs), wanted, frequent).groupBy("pattern").agg(F.approx_count_distinct("value", 0.02).alias("ordinary"))


def patterns(scanned: DataFrame, docs: DataFrame, frequent: list[str], rounds: int = ROUNDS, least: int = LEAST_SEEDS, confident: float = CONFIDENT, held_out: int = 0) -> DataFrame:
    """The patterns to trust: ``pattern, confidence, seeds``. Of 100 keys, ``held_out`` are no seeds, by their hash: for
    measuring how many values that nothing is known of the patterns find.

    Each edge of the graph is a pattern with a value that it stands beside. Copies of a text count once, as edges are
    distinct. A pattern needs a letter, a word that isn't ``frequent``, and ``least`` different values that are seeds or
    believed. Its odds are their belief against the doubt in its other values (``UNKNOWN`` each) and the ordinary tokens
    beside it, with a half added on either side, and ``confident`` is the probability that they must reach. A value of
    unknown form is believed as much as its best trusted pattern, and is a seed of the next round.
    """
    s = scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    known = F.col("kind").isin(*KINDS) | (F.col("kind") == "key") & (F.pmod("value", F.lit(100)) >= held_out)
    edges = s.groupBy("pattern", "value").agg(F.max(F.when(known, 1.0).otherwise(0.0)).alias("seed"))
    # a pattern with fewer values can't ever have enough seeds
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = F.regexp_extract_all(F.substring("pattern", 4, 1 << 20), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    usual = F.array(*map(F.lit, frequent)).cast("array<string>")
    letter = F.exists(words, lambda w: w.rlike(r"\p{L}"))
    enough = staged(enough.where(F.substring("pattern", 4, 1).eqNullSafe("#") & (F.length("pattern") == 36) | letter & (F.size(F.array_except(words, usual)) > 0)), "enough")
    enough = staged(possible(docs, enough, frequent, confident), "possible")
    edges = staged(edges.join(maybe_broadcast(enough, 200), "pattern"), "edges")
    beside = staged(ordinary(docs, enough, frequent), "ordinary")
    believed, n = None, 0
    for i in range(rounds + 1):
        seen = edges.withColumn("belief", F.col("seed"))
        if believed is not None:
            seen = edges.join(maybe_broadcast(believed, 32), "value", "left").withColumn("belief", F.greatest("seed", F.coalesce("best", F.lit(0.0))))
        belief, doubt = F.sum("belief").alias("belief"), F.sum(1 - F.col("belief")).alias("doubt")
        scored = seen.groupBy("pattern").agg(belief, doubt, F.sum((F.col("belief") >= confident).cast("long")).alias("seeds"))
        scored = scored.join(maybe_broadcast(beside, 200), "pattern", "left").withColumn("against", UNKNOWN * F.col("doubt") + F.coalesce("ordinary", F.lit(0)))
        odds = F.log(F.col("belief") + 0.5) - F.log(F.col("against") + 0.5)
        scored = scored.withColumn("confidence", 1 / (1 + F.exp(-odds))).select("pattern", "confidence", "seeds")
        trusted = staged(scored.where((F.col("confidence") >= confident) & (F.col("seeds") >= least)), "patterns")
        before, n = n, trusted.count()
        if n == before or i == rounds:  # belief only grows, so no pattern is lost again
            break
        best = edges.join(maybe_broadcast(trusted.select("pattern", "confidence"), 200), "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        believed = staged(best, "believed")
    return trusted


def discovered(scanned: DataFrame, trusted: DataFrame) -> DataFrame:
    """``row, doc_id, text_hash, start, end`` of the candidate tokens beside a trusted pattern."""
    c = scanned.select("row", "doc_id", "text_hash", F.explode("spans").alias("s")).where("s.kind in ('', 'key')")
    c = c.select("row", "doc_id", "text_hash", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    return c.join(maybe_broadcast(trusted.select("pattern"), 200), "pattern").select("row", "doc_id", "text_hash", "start", "end").distinct()


def _sent(df: DataFrame, ids: str) -> DataFrame:
    """A broadcast hint for a staged table if the measured sum of its arrays' sizes allows it."""
    size = df.agg(F.sum(F.size(ids).cast("long") * 32 + 150)).first()[0] or 0
    return F.broadcast(df) if size <= 32 << 20 else df


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    The counts and the digest cover the fixed forms; ``spans`` adds the identifiers that trusted patterns mark, as
    ``id:start:end`` after the others. Null and empty texts have none; repeated rows and null ids are scanned like any
    other; an empty table gives no rows; extra columns are ignored.
    """
    scanned = scan(docs)
    more = discovered(scanned, patterns(scanned, docs, frequent_words(docs))).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ids"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    text = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    ids = F.array_join(F.transform("ids", lambda s: F.concat_ws(":", F.lit("id"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    one = scanned.withColumn("base", text).join(_sent(staged(more, "ids"), "ids"), "row", "left")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    every = F.when(F.col("ids").isNull(), F.col("base")).when(F.col("base") == "", ids).otherwise(F.concat_ws(",", "base", ids))
    return one.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), every.alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or each run of overlapping spans, as the name of its first kind."""
    out, at = [], 0
    joined: list[list] = []
    for k, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if joined and b < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
        else:
            joined.append([k, b, e])
    for k, b, e in joined:
        out += [text[at:b], f"<{k.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (and ``n_chars``, if there, made right); no row is dropped.

    Null and empty texts stay; copies of a row are masked alike; an empty table stays empty; other columns, of any name,
    pass unchanged.
    """
    scanned = scan(docs)
    more = discovered(scanned, patterns(scanned, docs, frequent_words(docs))).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("ids"))
    names = docs.columns
    of, digest, found = (fresh(docs, x) for x in ("id_of", "text_hash", "ids_found"))
    more = staged(more.select(F.col("doc_id").alias(of), F.col("text_hash").alias(digest), F.col("ids").alias(found)), "ids")
    joined = docs.join(_sent(more, found), F.col("`doc_id`").eqNullSafe(F.col(of)) & (F.md5(F.col("`text`").cast("binary")) == F.col(digest)), "left").drop(of, digest)
    at, ids = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for x, more in zip(b.column(at), b.column(ids)):
                text = x.as_py()
                spans = base_spans(text) + [("id", s["start"], s["end"]) for s in more.as_py() or ()] if text else []
                new.append(masked(text, spans) if spans else text)
            columns = [pa.array(new, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.transform(in_arrow, run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
