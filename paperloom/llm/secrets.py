"""Secret scans: three base patterns, and credential-context values that would cost many guesses.

A value behind a credential word is segmented at least cost into words, dates, repeats, keyboard walks and brute-force
spans; the guesses of the cheapest segmentation decide whether it is a secret or a placeholder. Such spans are of kind
``guess`` and are added beside the base spans, unless those cover the whole value. Words are those of a fixed list, then
those of the corpus, by the number of documents that hold them, counted over all documents; the LEARNED_WORDS most frequent
ones are held by each worker.

Null text counts as empty. Texts without secrets have zero counts, and the digest of the empty string. Repeated rows give
repeated rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import forget, map_texts, materialise, settle, small_batches, trim

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words that make what follows them a credential, beyond those of the base pattern; the value runs to white space or a quote.
#: What follows ``bearer`` and a space is one only if it holds a digit.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth(?:orization)?|private[_-]?key|access[_-]?key|client[_-]?secret|login|pin)["']?[\x20\t]*(?:[:=]|=>)[\x20\t]*["']?(?:(?:bearer|basic|token)[\x20\t]+)?|bearer[\x20\t]+(?=[^\s"'<>]*[0-9]))([^\s"'<>]+)""",
    re.I | re.A,
)
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"login", b"pin")
VALUE_CHARS = 8
#: log10 of the guesses from which a value counts as a secret.
LEAST_LOG_GUESSES = 9.0

#: The usual passwords and fillers, likeliest first.
COMMON_WORDS = tuple(
    """password 123456 qwerty admin welcome letmein monkey dragon master login abc princess sunshine football iloveyou
    shadow superman michael secret changeme default example test user guest root pass token key value your none null true
    false string here placeholder insert xxxx sample dummy demo hello world public private access account name email
    server client service system temp local host prod dev staging summer winter spring autumn love star hunter ninja
    cookie cheese coffee computer internet charlie thomas jordan harley ranger buster soccer hockey killer george
    andrew daniel joshua pepper ginger matrix freedom batman tiger flower orange purple yellow silver golden""".split()
)
#: Words of the corpus, of so many letters, that are learned behind the fixed ones; distinct words that a task counts at a time.
LEARNED_WORDS, WORD_LETTERS, HELD_WORDS = 50_000, (4, 24), 300_000
CORPUS_WORD = re.compile(rb"[a-z]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LEET = str.maketrans("013457@$!", "oleastasi")
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEXT_KEY = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in KEY_ROWS for a, b in zip(row, row[1:])}
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?")
HEX_DIGITS = frozenset("0123456789abcdef")


def alphabet_size(value: str) -> int:
    lower = {c.lower() for c in value}
    if lower <= HEX_DIGITS:
        return 16
    return sum(n for n, kind in ((26, str.islower), (26, str.isupper), (10, str.isdigit)) if any(kind(c) for c in value)) + 33 * any(not c.isalnum() for c in value) or 26


CUT = math.log10(2)  # each further segment doubles what there is to try
DATE_COST = math.log10(365 * 200)
PERIODS = 8


class Stretch:
    """The cheapest begin of a segment that may begin anywhere in a stretch and costs the more the longer it is, by the
    logarithm of its length.

    A begin that has become dearer than an earlier one stays dearer, as their lengths grow alike. So begins are kept in a
    stack with the end from which each loses to the one below, the next to lose on top.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []
        self.loses: list[float] = []  # the end at which the begin above the k-th loses to it

    @staticmethod
    def meets(early: tuple[int, float], late: tuple[int, float]) -> float:
        """The end from which the earlier begin is no dearer than the later one."""
        (a, x), (b, y) = early, late
        if x >= y:
            return math.inf
        if y - x > 300:
            return b
        ratio = 10 ** (y - x)  # (end - a) / (end - b) must be no greater
        return (ratio * b - a) / (ratio - 1)

    def add(self, start: int, cost: float, end: int) -> None:
        """From ``end`` on a segment may begin at ``start``."""
        new = (start, cost)
        while self.starts:
            lost = self.meets(self.starts[-1], new)
            if lost <= end:
                return
            if self.loses and lost >= self.loses[-1]:
                self.starts.pop()
                self.loses.pop()
                continue
            self.loses.append(lost)
            break
        self.starts.append(new)

    def least(self, end: int) -> float:
        while self.loses and self.loses[-1] <= end:
            self.loses.pop()
            self.starts.pop()
        return min((cost + math.log10(end - start) for start, cost in self.starts[-1:]), default=math.inf)


def dates(value: str, start: int) -> list[int]:
    """The ends of the dates that begin at a place: a year, one with a month, one with a day."""
    m = DATE.match(value, start)
    return [end for end in range(start + 4, m.end() + 1) if DATE.fullmatch(value, start, end)] if m else []


class Guesser:
    """The guesses that values cost, with words ranked by how likely they are."""

    def __init__(self, learned: Iterable[str] = ()) -> None:
        self.rank = {w: k + 1 for k, w in enumerate(dict.fromkeys([*COMMON_WORDS, *learned]))}
        self.longest = max(map(len, self.rank))
        self.known: dict[str, float] = {}

    def words(self, value: str) -> dict[int, list[tuple[int, float]]]:
        """By end, the (start, cost) of the words and dates in a value."""
        n, low = len(value), value.lower()
        plain = low.translate(LEET)
        arcs: defaultdict[int, list[tuple[int, float]]] = defaultdict(list)
        for start in range(n):
            for end in range(start + 3, min(n, start + self.longest) + 1):
                asis, read = self.rank.get(low[start:end]), self.rank.get(plain[start:end])
                rank = min(asis or math.inf, 4 * read if read else math.inf)
                if rank < math.inf:
                    shouted = any(c.isupper() for c in value[start:end])
                    arcs[end].append((start, math.log10(rank + 1) + shouted * CUT))
            for end in dates(value, start):
                arcs[end].append((start, DATE_COST))
        return arcs

    def log_guesses(self, value: str) -> float:
        """log10 of the guesses for the cheapest of all segmentations.

        Neighbouring characters that are spelled out are one segment, so the cheapest way to each place is kept twice: with
        a spelled character before it, and with another segment. Repeats and walks may be any part of a longer one.
        """
        if value in self.known:
            return self.known[value]
        n, low, brute, arcs = len(value), value.lower(), math.log10(alphabet_size(value)), self.words(value)
        spelled, other = [math.inf] * (n + 1), [math.inf] * (n + 1)
        other[0] = -CUT  # the first segment takes no cut
        # walks, then repeats of each period: where the present stretch began, and its begins
        kinds = [(0, 3, math.log10(40))] + [(p, max(3, 2 * p), p * brute - math.log10(p)) for p in range(1, min(PERIODS, n // 2) + 1)]
        began, stretches = [0] * len(kinds), [Stretch() for _ in kinds]
        for end in range(1, n + 1):
            spelled[end] = brute + min(spelled[end - 1], other[end - 1] + CUT)
            best = min((min(spelled[start], other[start]) + CUT + cost for start, cost in arcs.get(end, ())), default=math.inf)
            for k, (period, least, cost) in enumerate(kinds):
                goes_on = end == 1 or ((low[end - 2], low[end - 1]) in NEXT_KEY if not period else end <= period or low[end - 1] == low[end - 1 - period])
                if not goes_on:
                    began[k], stretches[k] = end - max(1, period), Stretch()
                start = end - least
                if start >= began[k]:
                    stretches[k].add(start, min(spelled[start], other[start]) + CUT + cost, end)
                    best = min(best, stretches[k].least(end))
            other[end] = best
        found = max(0.0, min(spelled[n], other[n]))
        if n <= 64 and len(self.known) < 4096:
            self.known[value] = found
        return found


def learn_words(docs: DataFrame, text_col: str = "text", most: int = LEARNED_WORDS) -> list[str]:
    """The words that most documents hold, most frequent first; counted over all documents."""
    small_batches(docs.sparkSession)
    low, high = WORD_LETTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in found if low <= len(w) <= high]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([found[w] for w in words], pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(set(CORPUS_WORD.findall((text or b"").translate(LOWER))))
                if len(found) >= HELD_WORDS:
                    yield flush()
        if found:
            yield flush()
        trim()

    counts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter("n > 1"), "learned")
    # how often the last word of the list stands: the driver gets no rows of rarer ones, however many tasks there are
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).filter(F.col("upto") >= most).agg(F.max("n")).first()[0]
    found = counts.filter(F.col("n") >= (least or 0)).orderBy(F.desc("n"), "word").limit(most).collect()
    forget(counts)
    return [r.word for r in found]


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds, sorted; ``raw`` is the text in UTF-8, searched first for what all kinds need."""
    found = []
    low = raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if b"h" * HEX_CHARS in raw.translate(HEX_MARKS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


HEX_MARKS = bytes(ord("h") if chr(b) in HEX_DIGITS else 0 for b in range(256))
KINDS = ("assign", "access", "hex", "guess")


def guess_spans(text: str, raw: bytes, taken: list[tuple[int, int, int]], guesser: Guesser) -> list[tuple[int, int, int]]:
    """Credential-context values whose cheapest segmentation costs enough guesses, if the (sorted) spans taken don't cover them wholly."""
    low = raw.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found = []
    runs: list[list[int]] = []  # of taken spans that overlap or touch
    for a, _, b in taken:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    starts = [a for a, _ in runs]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:)]}|*#&%")
        start, end = m.start(1), m.start(1) + len(value)
        k = bisect.bisect_right(starts, start)
        covered = k and end <= runs[k - 1][1]
        if len(value) >= VALUE_CHARS and not covered and guesser.log_guesses(value) >= LEAST_LOG_GUESSES:
            found.append((start, 3, end))
    return found


def all_spans(raw: bytes, guesser: Guesser) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    text = raw.decode("utf-8", "replace")
    base = base_spans(text, raw)
    added = guess_spans(text, raw, base, guesser)
    return base, sorted(base + added) if added else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: counts by kind, the digest of the base spans, and all spans."""
    learned = df.sparkSession.sparkContext.broadcast(learn_words(df, text_col))

    def make():
        guesser = Guesser(learned.value)

        def work(ids, texts):
            rows = []
            for doc_id, raw in zip(ids, texts):
                base, spans = all_spans(raw or b"", guesser)
                kinds = [k for _, k, _ in spans]
                rows.append((doc_id, *(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        return work

    return map_texts(df, id_col, text_col, SCHEMA, make)


def redact_text(raw: bytes, guesser: Guesser, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by one mark; None if it has none."""
    _, spans = all_spans(raw, guesser)
    if not spans:
        return None
    text = raw.decode("utf-8", "replace")
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents, with all their columns, their secrets replaced; ``length_col`` follows where it exists."""
    small_batches(docs.sparkSession)
    learned = docs.sparkSession.sparkContext.broadcast(learn_words(docs, text_col))
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        guesser = Guesser(learned.value)
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            clean = [redact_text(t, guesser) if t else None for t in raw]
            columns = list(batch.columns)
            columns[at] = pa.array([t if c is None else c.encode() for t, c in zip(raw, clean)], pa.binary()).cast(batch.column(at).type)
            if length_at is not None:
                old = batch.column(length_at)
                columns[length_at] = pa.array([n if c is None else len(c) for n, c in zip(old.to_pylist(), clean)], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
