"""Pages that are keywords, tags or links instead of sentences.

1. One pass of Python reads each page: it cuts it into chunks, hashes their words, and lets rules label the clear pages of
   either kind, weakly: some features must all agree.
2. From the hashed words of labelled pages the log odds of every word are counted over all documents, in a table of fixed
   size.
3. Bagged decision trees learn from the chunks of the labelled pages (a sample of bounded size) what a chunk of stuffing
   looks like: its words' odds, links, tags, separators, repetition.
4. A page's share is the part of its text in chunks that the trees take for stuffing. As far as its chunks are in doubt, it
   is moved towards the rate of its host (here: the ``source``), which is counted without the page itself.

A chunk is a line, cut at the ends of sentences and, where there are none, after some words; links and long unbroken runs
are chunks of their own.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Buckets of the table of word odds; chunks that the trees learn from, at most about; trees and their depth.
BUCKETS, TRAIN_ROWS, TREES, DEPTH = 1 << 18, 60_000, 24, 6
#: Probability at which a chunk is as much stuffing as not.
CHUNK_EVEN = 0.6
#: How much sharper than its probability a chunk counts, as a power of its odds.
SHARP = 3.0
#: Words a chunk has at most; characters that a link or a run counts for, being one item among words; pages that count
#: for a host before its own do.
CHUNK_WORDS, ITEM_CHARS, HOST_PRIOR = 16, 12, 50.0

_URL = re.compile(
    r"\[[^\]\n]{0,80}\]\([^)\s]{1,300}\)|(?:https?://|www\.)[!-~]+|"
    r"\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,5}\.(?:example|test|invalid|com|net|org|info|shop|biz|io)\b(?:\.[a-z]{2,4}\b)?(?:[/?:][!-~]*)?",
    re.I,
)
_TAG = re.compile(r"#\w[\w-]*|\b[a-z_]{2,12}[=:](?!//)\S+", re.I)
_SEPARATOR = re.compile(r"[,;|/•★·+\-–—=:#、，；*>~»→]+|\n+")
_SENTENCE = re.compile(r"(?<=[.!?。！？؟।])[\"')\]]*\s+|(?<=[。！？])|\n+")
_END = re.compile(r"[.!?。！？؟।]")
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&(?:\w{2,8}|#\d{1,6});")
_ANCHOR = re.compile(r"<a\b[^<>\n]{0,40}?href\s*=\s*[\"']?([^\s\"'<>]{1,300})[^<>\n]{0,200}>([^<>\n]{0,80})</a>|\[url=([^\]\s]{1,300})\]([^\[\]\n]{0,80})\[/url\]", re.I)
_RUN = re.compile(r"[A-Za-z0-9]{40,}")
_UNSEEN = re.compile(r"[\p{Cf}\p{Mn}]|(?![\n\t])\p{Cc}")
_WORD = re.compile(r"[A-Za-z0-9]{40,}|[^\W\d_]+|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯฀-๿]")


def clean(text: str) -> str:
    """One spelling for all: compatibility forms, no invisible characters, links marked up in one way, spread-out letters
    drawn together."""
    t = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    t = _ANCHOR.sub(lambda m: f"[{m[2] or m[4] or ''}]({m[1] or m[3]})", t) if "<" in t or "[" in t else t
    t = _MARKUP.sub(" ", t)
    parts = t.split()
    if len(parts) >= 8 and sum(len(p) == 1 for p in parts) > 0.6 * len(parts):
        t = "\n".join(" ".join("".join(w.split()) for w in re.split(r"\s{2,}", line.strip())) for line in t.split("\n"))
    return t


def words(text: str) -> list[str]:
    """Lower-case words, whole; scripts without spaces give pairs of characters, a long unbroken run is one word."""
    found = _WORD.findall(text.casefold())
    if not _CJK.search(text):
        return found
    out = []
    for w in found:
        if len(w) > 2 and _CJK.search(w):
            out.extend(w[i : i + 2] for i in range(len(w) - 1))
        else:
            out.append(w)
    return out


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _apart(pattern, kind: str, pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Cuts what ``pattern`` matches out of the pieces of text; matches are pieces of that kind."""
    out = []
    for k, t in pieces:
        at = 0
        for m in pattern.finditer(t) if k == "text" else ():
            out += [("text", t[at : m.start()]), (kind, m.group())]
            at = m.end()
        out.append((k, t[at:]))
    return out


def items(text: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of the links, the runs and the text between them, in order; the pieces make up the text."""
    return _apart(_RUN, "run", _apart(_URL, "link", [("text", text)]))


def chunks(text: str) -> list[str]:
    out = []
    for piece in _SENTENCE.split(text):
        piece = (piece or "").strip()
        if not piece:
            continue
        parts = piece.split()
        if len(parts) <= CHUNK_WORDS and len(piece) <= 240:
            out.append(piece)
        elif len(parts) <= 2:
            out.extend(piece[i : i + 160] for i in range(0, len(piece), 160))
        else:
            n = -(-len(parts) // CHUNK_WORDS)
            size = -(-len(parts) // n)
            out.extend(" ".join(parts[i : i + size]) for i in range(0, len(parts), size))
    return out


def repetition(run: str) -> float:
    """Share of six-letter stretches that a run repeats, as one of joined keywords does; 0 for a drawn-out letter."""
    if len(set(run)) < 5:
        return 0.0
    grams = [run[i : i + 6] for i in range(len(run) - 5)]
    return 1 - len(set(grams)) / len(grams)


def _local_variety(w: list[str], span: int = 20) -> float:
    """Share of different words in stretches of ``span``, on average."""
    if not w:
        return 1.0
    parts = [w[i : i + span] for i in range(0, max(1, len(w) - span // 2), span)]
    return sum(len(set(p)) / len(p) for p in parts) / len(parts)


def _length_of(pattern, text: str) -> int:
    return sum(m.end() - m.start() for m in pattern.finditer(text))


def page_signals(pieces: list[tuple[str, str]], w: list[str], length: int) -> dict[str, float]:
    """What the weak labels rest on, of a cleaned text's pieces, its words and its length."""
    n = max(1, length)
    rest = " ".join(t for k, t in pieces if k != "link")
    links, n_links = sum(len(t) for k, t in pieces if k == "link"), sum(k == "link" for k, _ in pieces)
    ends = len(_END.findall(rest))
    lines = rest.count("\n")
    segments = len(_SEPARATOR.findall(rest)) + ends + 1
    tags = [m.end() - m.start() for m in _TAG.finditer(rest)]
    plain = len(_WORD.findall(_TAG.sub(" ", rest))) if tags else len(_WORD.findall(rest))
    counted = n_links + len(tags) if n_links or len(tags) > 1 else 0  # a single tag is no mass of tags
    return {
        "words": float(len(w)), "variety": _local_variety(w), "links": links / n, "tags": sum(tags) / n, "n_tags": float(len(tags)), "ends": 100 * ends / n,
        "segments": float(segments), "per_segment": len(w) / segments, "per_sentence": len(w) / max(1, ends + lines),
        "items": counted / max(1, counted + plain), "repeats": sum(len(t) for k, t in pieces if k == "run" and repetition(t) > 0.5) / n,
    }


def weak_label(s: dict[str, float]) -> int | None:
    """1 for clear stuffing, 0 for clear sentences and for a few plain words, else none."""
    if s["items"] > 0.5 and s["links"] + s["tags"] > 0.7 or s["repeats"] > 0.7:
        return 1
    if s["words"] < 8:
        return 0 if s["items"] < 0.3 else None
    if s["links"] > 0.7 or s["tags"] > 0.7 or (s["words"] >= 16 and s["variety"] < 0.45):
        return 1
    if s["words"] >= 24 and s["segments"] >= 8 and s["per_segment"] <= 3.2 and s["ends"] < 0.2:
        return 1
    if s["variety"] > 0.8 and s["links"] < 0.02 and s["tags"] < 0.02 and s["ends"] >= 0.8 and s["per_sentence"] >= 5:
        return 0
    return None


#: Of a chunk by itself, of its words' odds, and of it with one chunk on either side.
OWN = ("link", "tags", "separators", "variety", "common", "ends", "per_segment", "digits", "upper", "size", "run", "repeats", "page_words")
FEATURES = (*OWN, "keyword_share", "sentence_share", "odds", "near_odds", "near_variety")
PAGE = "label int, chars array<int>, n_words array<int>, ids array<int>, lengths array<int>, own array<float>"


def read_page(text: str) -> tuple[int, list[int], list[int], list[int], list[int], list[float]]:
    """Weak label (-1 for none) and, of each chunk, the characters it counts for, its number of words, their buckets and
    lengths, and the features that need no odds."""
    t = clean(text)
    pieces = items(t)
    parts = [(k, c, words(c)) for k, piece in pieces for c in (chunks(piece) if k == "text" else [piece])]
    w = [x for _, _, cw in parts for x in cw]
    signals = page_signals(pieces, w, len(t))
    label = weak_label(signals)
    counts, total, page_words = Counter(w), max(1, len(w)), float(np.log1p(len(w)))
    tagged = signals["n_tags"] > 1
    buckets = {x: bucket(x) for x in counts}
    chars, n_words, own = [], [], []
    for k, c, cw in parts:
        n = max(1, len(cw))
        twice = repetition(c) if k == "run" else 0.0
        separators = len(_SEPARATOR.findall(c)) if k == "text" else 0
        own += [
            float(k == "link"), _length_of(_TAG, c) / len(c) if tagged and k == "text" else 0.0, separators / n, len(set(cw)) / n, sum(counts[x] for x in cw) / n / total,
            float(_END.search(c[-3:]) is not None), len(cw) / (separators + 1), sum(map(str.isdigit, cw)) / n, sum(map(str.isupper, c)) / len(c), float(len(cw)),
            float(k == "run"), twice, page_words,
        ]
        chars.append(0 if not cw else len(c) if k == "text" or twice > 0.5 else ITEM_CHARS)
        n_words.append(len(cw))
    return -1 if label is None else label, chars, n_words, [buckets[x] for x in w], [len(x) for x in w], own


def read_pages(pages: DataFrame) -> DataFrame:
    """``read_page`` of each row, in place of its text."""
    kinds = dict(pages.dtypes)
    names = [c for c in pages.columns if c != "text"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = list(zip(*map(read_page, pdf["text"]), strict=True)) or [[]] * 6
            yield pdf[names].assign(**{c.split()[0]: list(v) for c, v in zip(PAGE.split(", "), got, strict=True)})

    return pages.mapInPandas(read, ", ".join(f"{c} {kinds[c]}" for c in names) + ", " + PAGE)


def word_odds(read: DataFrame) -> np.ndarray:
    """Log odds of stuffing by word bucket, from the weakly labelled among all pages; 0 for words not seen.

    A page counts a word once. The table has ``BUCKETS`` entries whatever the corpus, so it may be collected.
    """
    labelled = read.where("label >= 0").select("label", F.explode(F.array_append(F.array_distinct("ids"), F.lit(-1))).alias("bucket"))
    pdf = labelled.groupBy("bucket").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).toPandas()  # at most BUCKETS + 1 rows
    odds = np.zeros(BUCKETS)
    whole = pdf[pdf["bucket"] < 0]
    n_pos, n_neg = (float(whole[c].sum()) for c in ("pos", "neg"))
    pdf = pdf[pdf["bucket"] >= 0]
    pos, neg = pdf["pos"].to_numpy(float), pdf["neg"].to_numpy(float)
    # A word seen in few pages says little.
    weight = (pos + neg) / (pos + neg + 2.0)
    odds[pdf["bucket"].to_numpy(int)] = weight * (np.log((pos + 0.5) / (n_pos + 1.0)) - np.log((neg + 0.5) / (n_neg + 1.0)))
    return odds


def chunk_features(n_words: np.ndarray, ids: np.ndarray, lengths: np.ndarray, own: np.ndarray, first: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """All features of consecutive chunks; ``first`` marks the first chunk of each page, ``own`` has a row a chunk."""
    n = len(n_words)
    at = np.repeat(np.arange(n), n_words)
    o, mass = odds[ids], lengths.astype(float)
    sums = [np.bincount(at, weights=x, minlength=n) for x in (mass, mass * (o > 0.5), mass * (o < -0.5), mass * o)]
    shares = np.stack(sums[1:], axis=1) / np.maximum(sums[0], 1.0)[:, None]
    x = np.column_stack([shares[:, 2], own[:, OWN.index("variety")]])
    last = np.append(first[1:], True)
    before, after = np.where(first, np.arange(n), np.arange(n) - 1), np.where(last, np.arange(n), np.arange(n) + 1)
    return np.column_stack([own, shares, (x[before] + x + x[after]) / 3])


def score_pages(documents: DataFrame, seed: int = 8, host_pull: float = 1.0) -> DataFrame:
    """``doc_id, source, share, doubt, host_rate, score, stuffed`` for each row of ``documents``. Runs jobs.

    ``share`` is the share of the text that is stuffing, ``doubt`` how far that rests on chunks that could be either, and
    ``host_rate`` the rate of stuffed pages among the others of the host. ``score`` is the log odds of the share plus
    ``doubt`` times those of the host's rate; above 0 the page is stuffed.

    Null, empty and blank texts have share 0 and are not stuffed; a null source is a host of its own. Whole texts of any
    length are judged alike. If the rules label no page of one of the kinds, nothing is stuffed.
    """
    pages = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    read = stage(read_pages(pages.withColumn("row", F.monotonically_increasing_id())), "p8-pages")
    counts = {r["label"]: r["n"] for r in read.where("label >= 0").groupBy("label").agg(F.sum(F.size("chars")).alias("n")).collect()}
    joined = read.select("row", "doc_id", "source")
    zero = F.lit(0.0)
    if not all(counts.get(k) for k in (0, 1)):
        return joined.select("doc_id", "source", zero.alias("share"), zero.alias("doubt"), zero.alias("host_rate"), zero.alias("score"), F.lit(False).alias("stuffed"))
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(np.clip(word_odds(read), -5, 5))  # BUCKETS doubles
    columns = ", ".join(f"{f} double" for f in FEATURES)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = lambda c, kind: np.concatenate([np.asarray(v, dtype=kind) for v in c] + [np.zeros(0, kind)])
        for pdf in frames:
            pdf = pdf[pdf["chars"].map(len) > 0]
            if not len(pdf):
                continue
            size = pdf["chars"].map(len).to_numpy()
            first = np.zeros(size.sum(), dtype=bool)
            first[np.cumsum(size) - size] = True
            x = chunk_features(flat(pdf["n_words"], np.int64), flat(pdf["ids"], np.int64), flat(pdf["lengths"], np.int64), flat(pdf["own"], float).reshape(-1, len(OWN)), first, table.value)
            head = {"row": np.repeat(pdf["row"].to_numpy(), size), "label": np.repeat(pdf["label"].to_numpy(), size), "chars": flat(pdf["chars"], np.int64)}
            yield pd.concat([pd.DataFrame(head), pd.DataFrame(x, columns=list(FEATURES))], axis=1)

    parts = stage(read.select("row", "label", "chars", "n_words", "ids", "lengths", "own").mapInPandas(features, f"row long, label int, chars int, {columns}"), "p8-chunks")
    labelled = parts.where("label >= 0")
    share = {k: min(1.0, TRAIN_ROWS / 2 / n) for k, n in counts.items()}
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assemble.transform(labelled.sampleBy("label", share, seed)).select("features", F.col("label").cast("double").alias("label"))
    trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=0.7, seed=seed, maxBins=64)
    model = trees.fit(train)
    judged = model.transform(assemble.transform(parts)).select("row", "chars", vector_to_array("probability")[1].alias("q"))
    even = float(np.log(CHUNK_EVEN / (1 - CHUNK_EVEN)))
    judged = judged.withColumn("p", 1 / (1 + F.exp(-SHARP * (_log_odds(F.col("q")) - even))))
    mean = lambda c: F.coalesce(F.sum(F.col("chars") * c) / F.nullif(F.sum("chars"), F.lit(0)), zero)
    by_page = judged.groupBy("row").agg(mean(F.col("p")).alias("share"), mean(4 * F.col("p") * (1 - F.col("p"))).alias("doubt"))
    shares = stage(joined.join(by_page, "row", "left").select("doc_id", "source", F.coalesce("share", zero).alias("share"), F.coalesce("doubt", zero).alias("doubt")), "p8-shares")
    return smooth_by_host(shares, host_pull)


def _log_odds(c: Column) -> Column:
    inside = F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))
    return F.log(inside / (1 - inside))


def smooth_by_host(shares: DataFrame, host_pull: float = 1.0) -> DataFrame:
    """Adds ``host_rate``, ``score`` and ``stuffed`` to ``doc_id, source, share, doubt``.

    The rate of a host is counted over its other pages and ``HOST_PRIOR`` pages as they are everywhere. A page that is in
    no doubt keeps the sign of its share's log odds, whatever its host.
    """
    own = (F.col("share") > 0.5).cast("double")
    whole = float(shares.agg(F.avg(own)).first()[0] or 0.0)
    hosts = shares.groupBy("source").agg(F.sum(own).alias("bad"), F.count(F.lit(1)).alias("pages"))
    scored = shares.join(hosts, "source").withColumn("host_rate", (F.col("bad") - own + HOST_PRIOR * whole) / (F.col("pages") - 1 + HOST_PRIOR))
    # The trees saw as many chunks of either kind; where they can't tell, the rate of the host does.
    scored = scored.withColumn("score", _log_odds(F.col("share")) + F.lit(host_pull) * F.col("doubt") * _log_odds(F.col("host_rate")))
    return scored.select("doc_id", "source", "share", "doubt", "host_rate", "score", (F.col("score") > 0).alias("stuffed"))
