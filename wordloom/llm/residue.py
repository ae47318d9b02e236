"""Template residue, filler, error pages and script notices in texts.

Character n-gram models of four kinds of residue and of natural prose give each
character a log-likelihood ratio.  Windows whose mean ratio is high localise
residue; a sentence is residue when such windows cover most of it.  Of the other
localised sentences an exact check takes those that hold a blank of a template, and
the strong runs of windows at an end of a sentence, where residue joins prose without
a full stop; sentences that speak of templates and words as such are left alone.
The models start from independently written seeds and learn the wordings of the
collection from all of its texts, without labels.
"""

from __future__ import annotations

import contextlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.residue_seeds import seeds

CLASSES = ("template", "filler", "error", "notice")
#: Orders of the n-grams: the long one decides where either model has seen it, else the short one.
LONG, SHORT = 5, 3
TABLE_BITS = 18
#: Characters of a window; its mean ratio from which its middle counts as residue; share of a sentence that must.
WINDOW, RATIO, COVERAGE = 14, 0.6, 0.5
#: Characters and mean ratio from which a run of hot windows at an end of its sentence counts whatever its share; characters that may stand before and after it.
RUN, RUN_RATIO, RUN_BEFORE, RUN_AFTER = 8, 2.3, 2, WINDOW // 2
#: Characters of a run at the start of a sentence: prose may begin with a short one and go on about it.
RUN_FIRST = 18
#: Times one word stands in a row for the row to be filler.
ROW = 5
#: Characters processed together by a worker.
SPAN = 1 << 16


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by n-gram hash, one row per class, for both orders; ``unseen`` long ones fall back to short.

    Column by column in memory, as they are looked up; ``some``: which long ones any class falls back from; ``top``: highest long ratio of any class.
    """

    long: np.ndarray
    short: np.ndarray
    unseen: np.ndarray
    some: np.ndarray
    top: np.ndarray


#: Folded code points below 256; there lower case keeps its length.
_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[48:58], _FOLDED[:33], _FOLDED[160] = 48, 32, 32


def fold(text: str) -> np.ndarray:
    """Code points in lower case; digits are alike, and so are blanks. As long as the text."""
    low = text.lower()
    with contextlib.suppress(UnicodeEncodeError):
        return _FOLDED[np.frombuffer(low.encode("latin-1"), np.uint8)]
    if len(low) != len(text):  # a few letters grow in lower case
        low = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, text))
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    a[(a <= 32) | (a == 160) | ((a >= 0x2000) & (a <= 0x200B))] = 32
    return a


def grams(a: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position (zeros before the start)."""
    padded, h = np.concatenate((np.zeros(n - 1, np.uint32), a)).astype(np.uint64), np.zeros(len(a), np.uint64)
    for k in range(n):
        h = (h ^ padded[k : k + len(a)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _pieces(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Folded texts with single blanks, also before and after them, in parts of about ``SPAN``; whether a part repeats the end of the one before."""
    blank = np.array([32], np.uint32)
    for t in texts:
        a = np.concatenate((blank, fold(t), blank))
        a = a[squeezed(a)]
        for i in range(0, len(a), SPAN):
            yield a[max(0, i - LONG + 1) : i + SPAN], i > 0


def _counts(texts: Iterable[str]) -> np.ndarray:
    """How often each n-gram hash stands in the texts, one row per order.

    No n-gram reaches over the border of two texts, so the counts of a collection are
    the sum of those of its parts, however it is dealt.
    """
    total, parts, size = np.zeros((2, 1 << TABLE_BITS), np.int64), [], 0

    def add() -> None:
        a, lengths = np.concatenate([x for x, _ in parts]), np.array([len(x) for x, _ in parts])
        starts, repeats = np.cumsum(lengths) - lengths, np.array([r for _, r in parts])
        for i, n in enumerate((LONG, SHORT)):
            whole = np.ones(len(a) + LONG, bool)
            for k in range(LONG - 1):
                whole[(starts if k < n - 1 else starts[repeats]) + k] = False
            total[i] += np.bincount(grams(a, n)[whole[: len(a)]], minlength=1 << TABLE_BITS)

    for part in _pieces(texts):
        parts.append(part)
        size += len(part[0])
        if size >= SPAN:
            add()
            parts, size = [], 0
    if parts:
        add()
    return total


#: Times the models are fitted; share of a text that must be covered for all of it to be taken over; weight of a text taken over, and of the mentions.
FITS, ADOPTED, OWN_WEIGHT, MENTION_WEIGHT = 4, 0.7, 3.0, 10.0
#: N-grams of a collection against which the seeds have these weights; counts of a larger one, all of them, are brought to that sum.
WEIGHED = 1_000_000


def fit(prose: Sequence[str], by: Mapping[str, Sequence[str]] | None = None) -> Model:
    """Fit the ratios on the seeds and on ``prose``, unlabelled texts of the collection at hand, mostly natural.

    Fitted several times: what a fit finds in ``prose`` is left out of the natural
    prose of the next one, and texts that are covered for the most part are taken
    over, whole, as further examples of their class, so that the models learn the
    wordings of the collection.  ``by``: seeds per class.
    """
    return _fitted(lambda model: learned(prose, model), by)


def _fitted(count: Callable[[Model | None], np.ndarray], by: Mapping[str, Sequence[str]] | None = None) -> Model:
    """Fit on a collection for which ``count`` gives the sum of ``learned`` over all of it."""
    by = by or seeds()
    own = {c: _counts(by[c]) for c in (*CLASSES, "mention")}
    everything = moved = count(None)
    scale = min(1.0, WEIGHED / max(int(everything[0, 0].sum()), 1))
    for k in range(FITS):
        natural = scale * (everything[0] + (moved[0] if k else 0))
        tables = []
        for i in range(2):
            q = natural[i] + MENTION_WEIGHT * own["mention"][i]
            rows = []
            for j, c in enumerate(CLASSES):
                p = own[c][i] + OWN_WEIGHT * scale * moved[j + 1, i]
                # Counts are brought to the same size, so that the ratio does not depend on the collection's.
                r = np.log((p / max(p.sum(), 1) * 1e6 + 1) / (q / max(q.sum(), 1) * 1e6 + 1))
                r[(p == 0) & (q == 0)] = np.nan
                rows.append(r)
            tables.append(np.array(rows, np.float32))
        unseen = np.isnan(tables[0])
        long, short = (np.asfortranarray(np.nan_to_num(t)) for t in tables)
        model = Model(long, short, np.asfortranarray(unseen), unseen.any(axis=0), long.max(axis=0))
        if k + 1 < FITS:
            moved = count(model)
    return model


def learned(texts: Sequence[str], model: Model | None) -> np.ndarray:
    """What texts add to the counts of the prose (first row), and to those of the texts taken over, by class.

    Without a model all of them are prose; with one, the first row is the change that
    its findings make to that.  Rows of several parts of a collection add up.
    """
    if model is None:
        return np.stack([_counts(texts), *(np.zeros((2, 1 << TABLE_BITS), np.int64) for _ in CLASSES)])
    spans: dict[int, list] = {}
    for number, *span in scan(texts, model):
        spans.setdefault(number, []).append(span)
    natural, adopted = [], {}
    for number, found in spans.items():
        text = texts[number]
        if sum(e - s for s, e, *_ in found) >= ADOPTED * len(text.strip()):
            by_class = Counter()
            for s, e, kind, _ in found:
                by_class[kind] += e - s
            adopted.setdefault(by_class.most_common(1)[0][0], []).append(text)
            continue
        at = 0
        for s, e, *_ in found:
            natural.append(text[at:s])
            at = e
        natural.append(text[at:])
    before = _counts(texts[number] for number in spans)
    return np.stack([_counts(natural) - before, *(_counts(adopted.get(c, ())) for c in CLASSES)])


def squeezed(a: np.ndarray) -> np.ndarray:
    """Which characters stay when runs of blanks become one."""
    return ~((a == 32) & (np.concatenate(([0], a[:-1])) == 32))


class Ratios:
    """Ratios of characters; further blanks of a run have that of the first."""

    def __init__(self, a: np.ndarray, model: Model):
        keep = squeezed(a)
        b = a[keep]
        self.model, self.long = model, grams(b, LONG)
        self.rest = model.some[self.long]
        self.short = grams(b, SHORT) if self.rest.any() else None
        self.at = None if keep.all() else np.cumsum(keep) - 1

    def _of(self, at: np.ndarray) -> np.ndarray:
        m, long = self.model, self.long[at]
        r = m.long.T[long]
        rest = np.flatnonzero(self.rest[at])
        if len(rest):
            r[rest] = np.where(m.unseen.T[long[rest]], m.short.T[self.short[at[rest]]], r[rest])
        return r

    def highest(self) -> np.ndarray:
        """The highest of any class, per character."""
        top = self.model.top[self.long]
        rest = np.flatnonzero(self.rest)
        if len(rest):
            top[rest] = self._of(rest).max(axis=1)
        return top if self.at is None else top[self.at]

    def of(self, characters: np.ndarray) -> np.ndarray:
        """Those of some characters, one row per class."""
        return np.ascontiguousarray(self._of(characters if self.at is None else self.at[characters]).T)


_END = re.compile(r"\n+|(?<=[.!?])[\s\xa0]+")
#: The same ends, found faster: a match begins with the character before the blanks.
_BOUND = re.compile(r"[.!?\n](?:(?<=\n)\n*|(?<!\n)(?:\n+|[\s\xa0]+))")


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(text) if s.strip()]


def bounds(text: str) -> np.ndarray:
    """Starts of the sentences, beginning with 0."""
    ends = [0, *[m.end() for m in _BOUND.finditer(text)]]
    if ends[-1] == len(text) and len(ends) > 1:
        ends.pop()
    return np.array(ends, np.int64)


_NAME = r"[\w.\- |]{1,40}"
#: Blanks of templates as programs and editors write them (fixed values).
BLANK = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<%=?[^<>\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|\{(?:[a-z][\w.\-]{0,40}|\d)\}"
    r"|\$[a-z][\w.\-]{1,40}\$|%[a-z][\w.\-]{1,40}%|%\([\w.\-]{1,40}\)[sd]|__[a-z][a-z_.\-]{1,40}?__|\[\[[a-z][\w.\- ]{0,40}\]\]|@@[\w.\-]{1,40}@@|\*\|[^|\n]{1,40}\|\*"
    rf"|xxx[a-z_]{{2,40}}xxx|\[(?:insert|enter|insertar|inserte|insérer|your|ihr|votre|su)\s{_NAME}\]|\[{_NAME}\s(?:einfügen|eintragen|here|ici|aquí|to\s+follow|tbd)\]|\((?:add|insert)\s{_NAME}\)|<your\s{_NAME}>"
    rf"|<<{_NAME}>>|«{_NAME}_{_NAME}»|&lt;{_NAME}&gt;|\[object object\]|nan/nan/nan|(?<![\w%])%[sd]\b",
    re.I,
)
#: Words that speak of language, programs or templates as such: a blank beside one is spoken of, not left unfilled.
META = re.compile(
    r"\b(?:templates?|placeholders?|variables?|fields?|patterns?|regex\w*|expressions?|format strings?|syntax|macros?|shell|parser|scripts? we|the (?:words?|strings?|phrases?|letters?)"
    r"|replac(?:es|ed)|matches|prints|means|stands for|denotes|Vorlagen?|Platzhalter|Muster|Ausdruck|bedeutet|ersetzt|modèles?|motifs?|remplac\w+|signifie|plantillas?|patr(?:ón|ones)|reemplaza\w*|significa)\b",
    re.I,
)

def verdict(sentence: str, hot: np.ndarray, run: bool = False) -> str | None:
    """The exact check of one localised sentence: "all" of it is residue, or the "run" that joins prose, or neither (None).

    ``hot``: which characters lie in residue windows; ``run``: whether a strong run stands at an end.
    """
    if hot.mean() >= COVERAGE:
        return "all"
    rest, blanks = BLANK.subn(" ", re.sub(r"[\s\xa0]", " ", sentence))
    if META.search(rest):
        return None
    return "all" if blanks else "run" if run else None


def _units(texts: Sequence[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of texts that are looked at together: number of the text, offset, characters, sentence starts.

    A text longer than ``SPAN`` is cut between sentences.
    """
    for number, text in enumerate(texts):
        if not text or text.isspace():
            continue
        starts, whole, i = bounds(text), fold(text), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SPAN)))
            lo, hi = int(starts[i]), int(starts[j]) if j < len(starts) else len(text)
            yield number, lo, whole[lo:hi], starts[i:j] - lo
            i = j


def _rows(a: np.ndarray) -> np.ndarray:
    """Which characters lie in a row of ``ROW`` or more equal words."""
    solid, out = a > 32, np.zeros(len(a), bool)
    starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    if len(starts) < ROW:
        return out
    at = np.arange(len(a)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(a)]))))
    mixed = (a.astype(np.uint64) + np.uint64(1)) * (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    words = np.add.reduceat(np.where(solid, mixed ^ (mixed >> np.uint64(29)), np.uint64(0)), starts)
    same = np.flatnonzero(np.diff(np.concatenate(([0], (words[1:] == words[:-1]).astype(np.int8), [0]))))
    ends = np.append(starts[1:], len(a))
    for first, last in same.reshape(-1, 2):
        if last - first + 1 >= ROW:
            out[starts[first] : ends[last]] = True
    return out


def _run(chars: np.ndarray, hot: np.ndarray, ratio: np.ndarray) -> tuple[int, int] | None:
    """Start and end of the part of a sentence that its longest strong run of hot windows at one end marks, to that end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hot.astype(np.int8), [0]))))
    for _, a, b in sorted(((int(b - a), int(a), int(b)) for a, b in edge.reshape(-1, 2) if b - a >= RUN), reverse=True):
        at_start, at_end = np.count_nonzero(chars[:a] != 32) <= RUN_BEFORE, np.count_nonzero(chars[b:] != 32) <= RUN_AFTER
        if (at_end or (at_start and b - a >= RUN_FIRST)) and ratio[a:b].mean() >= RUN_RATIO:
            return 0 if at_start else a, len(chars) if at_end else b
    return None


def _windows(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sentences: where each starts when they are put side by side, lengths; of their characters: place, start and end of the window, cut at the ends of the sentence."""
    lengths = end - begin
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat(begin - first, lengths)
    left = np.maximum(np.repeat(begin, lengths), at - WINDOW // 2)
    right = np.minimum(np.repeat(end, lengths), at + WINDOW // 2 + 1)
    return first, lengths, at, left, right


def _hot_sentences(units: list, model: Model) -> Iterator[tuple[int, int, int, str, np.ndarray, tuple[int, int] | None]]:
    """Sentences with a residue window in some units: number of the text, start, end, class, characters covered, run that counts by itself."""
    gap = np.zeros(LONG - 1, np.uint32)  # keeps the n-grams of neighbouring units apart
    a = np.concatenate([x for *_, part, _ in units for x in (gap, part)])
    sizes = np.array([len(part) for *_, part, _ in units])
    at_unit = np.cumsum(sizes + len(gap)) - sizes
    begin = np.concatenate([own + at for (*_, own), at in zip(units, at_unit, strict=True)])
    unit = np.repeat(np.arange(len(units)), [len(own) for *_, own in units])
    end = np.append(begin[1:], len(a))
    last = np.append(unit[1:] != unit[:-1], True)
    end[last] = (at_unit + sizes)[unit[last]]
    ratio, row = Ratios(a, model), _rows(a)
    # No class has a higher mean than that of the highest ratios, so most sentences need no look at each class.
    first, lengths, at, left, right = _windows(begin, end)
    total = np.concatenate(([0.0], np.cumsum(ratio.highest(), dtype=np.float64)))
    maybe = (total[right] - total[left] > (RATIO - 1e-6) * (right - left)) | row[at]
    near = np.logical_or.reduceat(maybe, first)
    if not near.any():
        return
    begin, end, unit = begin[near], end[near], unit[near]
    first, lengths, at, left, right = _windows(begin, end)
    # Places of the remaining sentences, put side by side.
    shift = np.repeat(begin - first, lengths)
    left, right = left - shift, right - shift
    r, best = ratio.of(at), None
    sums = np.zeros((len(CLASSES), len(begin)))
    for k in range(len(CLASSES)):
        total = np.concatenate(([0.0], np.cumsum(r[k], dtype=np.float64)))
        mean = total[right] - total[left]
        best = mean if best is None else np.maximum(best, mean, out=best)
        sums[k] = total[first + lengths] - total[first]
    width = right - left
    hot = (best > RATIO * width) | row[at]
    share = np.add.reduceat(hot, first, dtype=np.int64) / lengths
    for k in np.flatnonzero(share > 0):
        number, lo = units[unit[k]][:2]
        s, part = lo + int(begin[k] - at_unit[unit[k]]), slice(first[k], first[k] + lengths[k])
        run = _run(a[begin[k] : end[k]], hot[part], best[part] / width[part]) if share[k] < COVERAGE else None
        by_class = sums[:, k] if run is None else r[:, first[k] + run[0] : first[k] + run[1]].sum(axis=1)
        if row[begin[k] : end[k]].mean() >= COVERAGE:
            by_class = np.array([c == "filler" for c in CLASSES])
        yield number, s, s + int(lengths[k]), CLASSES[int(np.argmax(by_class))], hot[part], run


def _checked(units: list, model: Model, texts: Sequence[str]) -> Iterator[tuple[int, int, int, str, float]]:
    for number, s, e, kind, hot, run in _hot_sentences(units, model):
        what = verdict(texts[number][s:e], hot, run is not None)
        if what == "all":
            yield number, s, e, kind, float(hot.mean())
        elif what == "run":
            # The prose it joins is no residue.
            yield number, s + run[0], s + run[1], kind, float(hot.mean())


def scan(texts: Sequence[str], model: Model) -> Iterator[tuple[int, int, int, str, float]]:
    """Residue sentences of several texts: number of the text, start, end, class and share of the sentence covered by residue windows."""
    units, size = [], 0
    for u in _units(texts):
        if units and size + len(u[2]) > SPAN:
            yield from _checked(units, model, texts)
            units, size = [], 0
        units.append(u)
        size += len(u[2])
    if units:
        yield from _checked(units, model, texts)


def localise(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """Residue sentences of one text: start, end, class and share."""
    return [x[1:] for x in scan([text], model)]


#: Characters of a text at most in the small collections of the tests; nothing here is limited by it.
SAMPLE_CHARS = 4000


def fit_on(documents: DataFrame, id: str, text: str) -> Model:
    """Fit on all texts of a table, whole: ``FITS`` passes, in each of which workers count and only summed counts, of fixed size, reach the driver.

    The sums are exact, so the model depends neither on the order of the rows nor on how they are dealt.  Null texts add nothing; ``id`` is not read.
    """
    shape = (1 + len(CLASSES), 2, 1 << TABLE_BITS)
    rows = documents.select(F.col(text).alias("text")).where("text is not null")

    def count(model: Model | None) -> np.ndarray:
        shared = documents.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for batch in batches:
                total += learned(batch["text"].to_pylist(), shared.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], ["at", "n"])

        summed = rows.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(shape, np.int64)
        total.ravel()[summed["at"].to_numpy()] = summed["n"].to_numpy()
        shared.destroy()
        return total

    return _fitted(count)


def find_residue(documents: DataFrame, id: str, text: str, model: Model) -> DataFrame:
    """Residue sentences of all documents: ``id``, start, length, kind and covered.

    Whole texts are read; null and blank texts have none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keys, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            rows = [(keys[n], s, e - s, kind, share) for n, s, e, kind, share in scan(texts, m)]
            if rows:
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "start", "length", "kind", "covered"])

    rows = documents.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "id bigint, start bigint, length bigint, kind string, covered double").withColumnRenamed("id", id)


def exclusion(spans: DataFrame, documents: DataFrame, id: str, length: Column, drop_from: float = 0.3) -> DataFrame:
    """Per document with residue: characters of it, share of the text, and whether to drop or only to cut it."""
    kinds = spans.groupBy(id, "kind").agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("spans"))
    main = F.max_by("kind", F.struct("chars", "kind"))
    per = kinds.groupBy(id).agg(F.sum("chars").alias("residue_chars"), F.sum("spans").alias("spans"), main.alias("kind"))
    share = F.col("residue_chars") / F.col("chars")
    return per.join(documents.select(id, length.alias("chars")), id).withColumn("share", share).withColumn("action", F.when(share >= drop_from, "drop").otherwise("cut"))
