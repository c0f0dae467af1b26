"""Quality rules: word counts and repeats, and distance of a document's histograms from its language.

Two histograms per document, of character classes and of common words, are compared with references by
Jensen-Shannon distance (base 2, so 0 to 1). The references are the summed histograms of all documents
of its language; a document without a language uses the closest of the ``sent_languages`` languages with most
documents. A histogram is only judged when the document is long enough for it.

No document without common words is farther than 0.3 to 0.4 from its language, and good short ones reach 0.45, so the
distance cannot tell it: beside it, common words must make up ``least_common`` of the language's share at least, unless
chance explains so few (``chance`` standard deviations of a binomial count). A language whose words are not among
``COMMON`` (a share below ``listed_share``) has no such bound.

Defined cases: a null text has no words, fails the base rules and is not kept; very long texts are judged whole, a text
at a time; repeated rows are judged each; a null language takes the closest reference, of equally close ones that of the
language with more documents, then the name that sorts first; an empty table gives no rows; other columns pass through
``accepted`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clientlens.llm.common import OWN, arrow_step, content, documents, pieces, raw, written

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Common words of the languages that the references know apart.
COMMON = (
    "the of and to in a is that for it as was with be by on not he are this at from or have an they which one you were",
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei",
    "la le les et des du un une dans que qui pour est sur pas plus par je avec tout faire son mettre autre on mais nous comme ou si",
    "el los del se las por con una su para es al lo como más pero sus este ya entre cuando muy sin sobre ser también me hasta hay donde",
)
CLASSES = ("lower", "upper", "digit", "space", "sentence", "inner", "symbol", "other", "beyond")


def _class_table() -> np.ndarray:
    """Class of each byte; bytes that continue a character have none."""
    table = np.full(256, CLASSES.index("other"))
    table[ord("a"):ord("z") + 1] = CLASSES.index("lower")
    table[ord("A"):ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0"):ord("9") + 1] = CLASSES.index("digit")
    table[list(SPACES)] = CLASSES.index("space")
    table[list(b".,;:?!")] = CLASSES.index("sentence")
    table[list(b"'\"()-_/")] = CLASSES.index("inner")
    table[list(b"#*$%&|<>@^~+=\\{}[]`")] = CLASSES.index("symbol")
    table[0xC0:] = CLASSES.index("beyond")
    table[0x80:0xC0] = len(CLASSES)
    return table


CLASS = _class_table()
WORD = {w.encode(): i + 1 for i, w in enumerate(sorted({w for words in COMMON for w in words.split()}))}
#: Everything but ASCII letters, digits and bytes beyond ASCII parts words for the common-word histogram.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()
N_CLASSES, N_WORDS = len(CLASSES), len(WORD) + 1


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    guard_chars: int = 200
    class_distance: float = 0.35
    guard_words: int = 60
    word_distance: float = 0.5
    least_common: float = 0.4
    chance: float = 3.5
    listed_share: float = 0.05
    sent_languages: int = 200


def histograms(text: bytes, by_byte: np.ndarray) -> np.ndarray:
    """Character classes, then other words, then the common words."""
    classes = np.bincount(CLASS, weights=by_byte, minlength=N_CLASSES + 1)[:N_CLASSES]
    words = text.translate(PLAIN).split()
    found = np.fromiter(map(WORD.get, words, repeat(0)), dtype=np.int64, count=len(words))
    return np.concatenate([classes, np.bincount(found, minlength=N_WORDS)])


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows that occur at least twice, the first one included."""
    if len(words) <= window:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    ids = (ids ^ (ids >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    n = len(ids) - window + 1
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0xD6E8FEB86659FD93) + ids[k:k + n]
    keys ^= keys >> np.uint64(29)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((change.cumsum()[:-1] > 0).sum())


def measures(text: bytes, by_byte: np.ndarray, window: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    characters = len(text) - int(by_byte[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), characters - int(by_byte[list(SPACES)].sum()), int(by_byte[list(SYMBOLS)].sum()),
            len(lines) - len(set(lines)), repeated_words(words, window))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a histogram ``p`` from the rows of ``q``, all summing to one."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Summed histograms and number of documents by language: lang, n, sums."""
    width = N_CLASSES + N_WORDS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sums: dict[str, np.ndarray] = {}
            for name, body in zip(batch["lang"].to_pylist(), raw(batch["text"]), strict=True):
                by_byte = np.bincount(np.frombuffer(body, dtype=np.uint8), minlength=256)
                total = sums.setdefault(name, np.zeros(width + 1))
                total[:width] += histograms(body, by_byte)
                total[width] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    parts = arrow_step(docs.select(F.col(lang).cast("string").alias("lang"), content(text).alias("text")).where(F.col("lang").isNotNull()), step, "lang string, sums array<double>")
    return written(parts.groupBy("lang").agg(F.sum(F.col("sums")[width]).alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")), "references")


def shares(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes and of the words, from summed histograms."""
    return tuple(part / np.maximum(part.sum(axis=-1, keepdims=True), 1) for part in (sums[..., :N_CLASSES], sums[..., N_CLASSES:]))


class Judge:
    """Distances from the references, and the verdict.

    ``sums`` holds the summed histograms of the languages with most documents. A language that is not among them comes with
    its own, a document without a language takes the closest of these.
    """

    def __init__(self, sums: dict[str, np.ndarray], rules: Rules):
        self.rules = rules
        self.names = {name: i for i, name in enumerate(sums)}
        self.classes, self.words = shares(np.array(list(sums.values())).reshape(-1, N_CLASSES + N_WORDS))

    def _from(self, counts: np.ndarray, table: np.ndarray) -> tuple[float, np.ndarray | None]:
        """Distance from the closest row of the references, and that row."""
        if not len(table) or not counts.sum():
            return 0.0, None
        found = distance(counts / counts.sum(), table)
        return float(found.min()), table[int(found.argmin())]

    def _references(self, lang: str | None, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The rows to compare with: one for a language, all without."""
        if own is not None:
            return tuple(part[None] for part in shares(np.asarray(own)))
        at = self.names.get(lang)
        return (self.classes, self.words) if at is None else (self.classes[at:at + 1], self.words[at:at + 1])

    def few_common(self, counts: np.ndarray, row: np.ndarray | None) -> bool:
        """Whether common words are far fewer than in the reference ``row``, beyond what chance explains."""
        share = 0.0 if row is None else 1 - row[0]
        if share < self.rules.listed_share:
            return False
        n, wanted = counts[1:].sum(), counts.sum() * share
        return bool(n < self.rules.least_common * wanted and wanted - n > self.rules.chance * np.sqrt(wanted * (1 - share)))

    def judge(self, text: bytes, lang: str | None, own: np.ndarray | None = None) -> tuple:
        """The five measures, the two distances (0 where guarded), base_failed, kept."""
        by_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        found = measures(text, by_byte, self.rules.window)
        failed = found[0] < self.rules.least_words or 100 * found[4] > self.rules.repeat_percent * found[0]
        counts = histograms(text, by_byte)
        of_classes, of_words = self._references(lang, own)
        classes, _ = self._from(counts[:N_CLASSES], of_classes) if counts[:N_CLASSES].sum() >= self.rules.guard_chars else (0.0, None)
        words, row = self._from(counts[N_CLASSES:], of_words) if counts[N_CLASSES:].sum() >= self.rules.guard_words else (0.0, None)
        kept = not failed and classes <= self.rules.class_distance and words <= self.rules.word_distance and not self.few_common(counts[N_CLASSES:], row)
        return (*found, classes, words, failed, kept)


def _judge(docs: DataFrame, rules: Rules, text: str, lang: str) -> tuple[Judge, Callable[[DataFrame, str], DataFrame]]:
    """The judge, and how rows get the reference of their language, where the judge does not hold it.

    The histograms of the ``sent_languages`` languages with most documents travel with the code. Where there are more
    languages, the others' are joined to the rows by language.
    """
    found = references(docs, text, lang)
    first = found.orderBy(F.desc("n"), "lang").limit(rules.sent_languages + 1).collect()
    judge = Judge({r["lang"]: np.array(r["sums"]) for r in first[:rules.sent_languages]}, rules)
    if len(first) <= rules.sent_languages:
        return judge, lambda rows, name: rows.withColumn(f"{OWN}own", F.lit(None).cast("array<double>"))
    sent = list(judge.names)
    rest = found.where(~F.col("lang").isin(sent)).select(F.col("lang").alias(f"{OWN}of"), F.col("sums").alias(f"{OWN}own"))
    return judge, lambda rows, name: rows.join(rest, F.col(name) == F.col(f"{OWN}of"), "left").drop(f"{OWN}of")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
TYPES = (*["long"] * 5, "double", "double", "boolean", "boolean")


def judged(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id and the measures, distances and verdicts."""
    judge, with_own = _judge(docs, rules, text, lang)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [judge.judge(*row) for row in zip(raw(batch["text"]), batch["lang"].to_pylist(), batch[f"{OWN}own"].to_pylist(), strict=True)]
            columns = [pa.array(x, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for x, t in zip(zip(*found, strict=True), TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *NAMES])

    rows = docs.select(F.col(id_column).alias("doc_id"), content(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return arrow_step(with_own(rows, "lang"), step, "doc_id long, " + ", ".join(f"{n} {t}" for n, t in zip(NAMES, TYPES, strict=True)))


def accepted(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns; each row is judged where it is read."""
    judge, with_own = _judge(docs, rules, text, lang)
    body, name, own, columns = f"{OWN}text", f"{OWN}lang", f"{OWN}own", docs.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = [judge.judge(*row)[-1] for row in zip(raw(batch[body]), batch[name].to_pylist(), batch[own].to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

    rows = docs.withColumns({body: content(text), name: F.col(lang).cast("string")})
    return arrow_step(with_own(rows, name), step, docs.schema)


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdicts of the whole table."""
    return judged(documents(spark, folder))
