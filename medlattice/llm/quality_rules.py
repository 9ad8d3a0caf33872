"""Quality rules by distribution divergence.

Every language's reference is its histogram of character classes and of common
words over all documents of the corpus that pass the base rule. A document is compared with the
reference of its declared language, or with the nearest reference where its
language is null or has none, by Jensen-Shannon distance (base 2, 0 to 1).

Defined results: a null or empty text has zero counts, fails the base rule
(fewer than 50 words) and is not kept. A document shorter than ``min_chars`` or
``min_words`` isn't judged by the histogram of characters or words. Repeated
rows are judged alike. A language with fewer than ``min_reference_words`` words
has no reference; with no reference at all only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, narrow, table
from .words import Block, U, blocks, class_counts, mix

#: Common function words whose shares are compared.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out so said what up its about into than them can only other".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man".split(),
    "fr": "le la les de et des en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux cette mais comme leur deux nous".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya o este si porque esta entre cuando muy sin sobre también me hasta hay".split(),
}
SYMBOLS = b"#*$%&|<>"
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "break", "stop", "mark", "symbol", "two_byte", "three_byte", "four_byte")


@dataclass(frozen=True)
class Limits:
    min_chars: int = 200
    min_words: int = 50
    #: A short text's histogram strays by chance; the limits widen by the slack over the root of its words.
    char_distance: float = 0.17
    char_slack: float = 0.5
    word_distance: float = 0.19
    word_slack: float = 2.2
    min_reference_words: int = 200
    base_words: int = 50
    base_repeat_percent: int = 50


def _byte_classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("mark"), np.int8)
    for name, chars in (("vowel", b"aeiouy"), ("consonant", b"bcdfghjklmnpqrstvwxz"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("space", b" "), ("break", b"\t\n\v\f\r"), ("stop", b".,;:!?"), ("symbol", SYMBOLS), ("two_byte", bytes(range(0xC0, 0xE0))), ("three_byte", bytes(range(0xE0, 0xF0))), ("four_byte", bytes(range(0xF0, 256)))):
        out[list(chars)] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)  # later bytes of a character: not counted
    return out


_CLASS = _byte_classes()


def _vocabulary() -> np.ndarray:
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    data = " ".join(words).encode()
    block = Block(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True)
    return np.sort(block.hashes)


_VOCABULARY = _vocabulary()
N_CHAR, N_WORD = len(CLASSES), len(_VOCABULARY) + 1


def histograms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last bin: all others) for each document."""
    docs = len(block.offsets) - 1
    chars = class_counts(_CLASS, block.data, block.offsets, N_CHAR + 1)[:, :N_CHAR]
    lowered = block.lowered()
    found = np.searchsorted(_VOCABULARY, lowered.hashes)
    found[found == len(_VOCABULARY)] = 0
    found = np.where(_VOCABULARY[found] == lowered.hashes, found, len(_VOCABULARY))
    owner = np.repeat(np.arange(docs), np.diff(block.first))
    return chars, np.bincount(owner * N_WORD + found, minlength=docs * N_WORD).reshape(docs, -1)


def base_counts(block: Block, chars: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the base rules; ``chars`` are the histograms of character classes."""
    docs, data = len(block.offsets) - 1, block.data
    words = np.diff(block.first)
    repeated = np.zeros(len(block.starts) + 3, bool)
    if len(block.starts) >= 3:
        tri = block.grams(3)
        owner = np.repeat(np.arange(docs, dtype=np.int32), words)
        place = np.flatnonzero(owner[2:] == owner[: len(tri)])
        key = tri[place] ^ mix(owner[place].astype(U))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = place[order[np.append(same, False) | np.append(False, same)]] if len(place) else place
        for j in range(3):
            repeated[hit + j] = True
    ends = np.concatenate([[0], np.cumsum(repeated[: len(block.starts)])])[block.first]
    dup = np.zeros(docs, np.int64)
    for i in range(docs):
        lines = [x for x in data[block.offsets[i] : block.offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    at = {c: chars[:, i] for i, c in enumerate(CLASSES)}
    return {"n_words": words.astype(np.int64), "word_chars": chars.sum(1) - at["space"] - at["break"], "n_symbols": at["symbol"].astype(np.int64), "n_dup_lines": dup, "n_repeat_words": np.diff(ends).astype(np.int64)}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of p and q (counts; an empty row is at distance 1)."""
    p, q = p.astype(float), q.astype(float)
    sp, sq = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    p, q = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (p + q) / 2

    def kl(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    out = np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))
    return np.where((sp[..., 0] == 0) | (sq[..., 0] == 0), 1.0, out)


def _base_failed(base: dict[str, np.ndarray], limits: Limits) -> np.ndarray:
    return (base["n_words"] < limits.base_words) | (100 * base["n_repeat_words"] > limits.base_repeat_percent * base["n_words"])


def references(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each language's two histograms over all its documents that pass the base rule; the sums are made on the executors."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(batch.schema.get_field_index(lang)).to_pylist(), object)
            total: dict[str, np.ndarray] = {}
            for a, b, block in blocks(batch, text=text):
                chars, words = histograms(block)
                own = np.where(_base_failed(base_counts(block, chars), limits), None, langs[a:b])
                both = np.hstack([chars, words])
                for name in {x for x in own if x is not None}:
                    total[name] = total.get(name, 0) + both[own == name].sum(0)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    parts = narrow(docs, text, lang).mapInArrow(run, "lang string, counts array<bigint>")
    sums = parts.select("lang", F.posexplode("counts").alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x bins
        out.setdefault(r["lang"], np.zeros(N_CHAR + N_WORD, np.int64))[r["bin"]] = r["n"]
    return {k: (v[:N_CHAR], v[N_CHAR:]) for k, v in sorted(out.items())}


def _nearest(hist: np.ndarray, refs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance to the own reference, or to the nearest one where there is none (-1)."""
    out = np.zeros(len(hist))
    for k in np.unique(own[own >= 0]):
        out[own == k] = js_distance(hist[own == k], refs[k][None, :])
    free = own < 0
    if free.any():
        out[free] = np.min([js_distance(hist[free], r[None, :]) for r in refs], 0)
    return out


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def divergence_filter(docs: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]], limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the base counts, both distances (null where not judged) and the verdict ``kept``."""
    refs = {k: v for k, v in refs.items() if v[1].sum() >= limits.min_reference_words}
    names = list(refs)
    chars, words = (np.array([refs[k][i] for k in names]) for i in (0, 1))

    def run(batch, text):
        number = {k: i for i, k in enumerate(names)}
        own = np.array([number.get(x, -1) for x in batch.column(batch.schema.get_field_index(lang)).to_pylist()], np.int64)
        cols: dict[str, list] = {}
        for a, b, block in blocks(batch, text=text):
            hist = histograms(block)
            base = base_counts(block, hist[0])
            n, length = base["n_words"], base["word_chars"]
            base["base_failed"] = _base_failed(base, limits)
            dist = [_nearest(h, r, own[a:b]) if names else np.zeros(b - a) for h, r in zip(hist, (chars, words), strict=True)]
            judged_c, judged_w = (length >= limits.min_chars) & bool(names), (n >= limits.min_words) & bool(names)
            root = np.sqrt(np.maximum(n, 1))
            far = judged_c & (dist[0] > limits.char_distance + limits.char_slack / root) | judged_w & (dist[1] > limits.word_distance + limits.word_slack / root)
            base["kept"] = ~base["base_failed"] & ~far
            base["char_distance"], base["word_distance"] = np.where(judged_c, dist[0], np.nan), np.where(judged_w, dist[1], np.nan)
            for k, v in base.items():
                cols.setdefault(k, []).append(v)
        return {k: pa.array(np.concatenate(v), from_pandas=True) for k, v in cols.items()}

    return annotate(docs, run, RESULT, text, (lang,))


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    judged = divergence_filter(docs, references(docs))
    # engines sum in other orders, so distances agree to some digits only
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def _sql() -> str:
    """The same in SQL: characters and words as bins, distances by joins with the references."""
    ascii_sets = {"vowel": "aeiouy", "consonant": "bcdfghjklmnpqrstvwxz", "upper": "A-Z", "digit": "0-9", "space": " ", "break": r"\t\n\x0B\f\r", "stop": ".,:;!?", "symbol": r"#*$%&|<>"}
    wide = {"two_byte": r"\x{80}-\x{7FF}", "three_byte": r"\x{800}-\x{FFFF}", "four_byte": r"\x{10000}-\x{10FFFF}"}
    known = {**ascii_sets, **wide}
    classes = [f"('{c}', length(t) - length(regexp_replace(t, '[{known[c]}]', '', 'g')))" for c in CLASSES if c != "mark"]
    classes.append("('mark', length(regexp_replace(t, '[" + "".join(known.values()) + "]', '', 'g')))")
    listed = ", ".join(f"{{'bin': {c[1 : c.index(',')]}, 'n': {c[c.index(',') + 2 : -1]}}}" for c in classes)
    words = ", ".join(f"'{w}'" for w in sorted({w for ws in COMMON_WORDS.values() for w in ws}))
    limits = Limits()
    half = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"

    def distances(bins: str, out: str) -> str:
        p, q = "coalesce(b.n / s.n, 0)", "r.n / r.total"
        return f"""
{bins}_s AS (SELECT doc_id, sum(n)::DOUBLE AS n FROM {bins} GROUP BY doc_id),
{bins}_r AS (SELECT lang, bin, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY lang))::DOUBLE AS total FROM (SELECT lang, bin, sum(n) AS n FROM {bins} JOIN base USING (doc_id) JOIN refs USING (lang) WHERE NOT base_failed GROUP BY ALL)),
{out} AS (SELECT doc_id, min(dist) AS {out} FROM (SELECT p.doc_id, p.ref, CASE WHEN any_value(s.n) > 0 THEN sqrt(least(1, greatest(0, sum({half.format(p, q)} + {half.format(q, p)}) / 2))) ELSE 1 END AS dist
  FROM pairs p LEFT JOIN {bins}_s s USING (doc_id) JOIN {bins}_r r ON r.lang = p.ref LEFT JOIN {bins} b ON b.doc_id = p.doc_id AND b.bin = r.bin GROUP BY ALL) GROUP BY doc_id)"""

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM tri), range(3) AS x(k) WHERE m > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, w.lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ws) < {limits.base_words} OR 100 * coalesce(rep.n, 0) > {limits.base_repeat_percent} * len(ws) AS base_failed FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
refs AS (SELECT lang FROM base WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {limits.min_reference_words}),
pairs AS (SELECT doc_id, refs.lang AS ref FROM base, refs WHERE base.lang = refs.lang OR base.lang IS NULL OR base.lang NOT IN (SELECT lang FROM refs)),
chars AS (SELECT doc_id, x.bin AS bin, x.n AS n FROM (SELECT doc_id, unnest([{listed}]) AS x FROM d) WHERE x.n > 0),
words AS (SELECT doc_id, CASE WHEN v IN ({words}) THEN v ELSE '' END AS bin, count(*) AS n FROM (SELECT doc_id, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS v FROM w) GROUP BY ALL),
{distances("chars", "cd")},
{distances("words", "wd")},
judged AS (SELECT base.*, CASE WHEN word_chars >= {limits.min_chars} THEN cd END AS cd, CASE WHEN n_words >= {limits.min_words} THEN wd END AS wd FROM base LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(cd > {limits.char_distance} + {limits.char_slack} / sqrt(n_words), false) AND NOT coalesce(wd > {limits.word_distance} + {limits.word_slack} / sqrt(n_words), false) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM judged
"""


OP1_SQL = _sql()
