"""Language of web pages by Bayesian evidence fusion.

Evidence for each language of a page:

* the text: a multinomial model over hashed byte trigrams, trained on labelled documents (a bounded sample of
  whole texts; one that does not fit is passed over; a language without one that fits learns from its shortest text),
  tempered because trigrams of one text are not independent;
* the markup's declared language: how often a declaration is right is estimated from the pages themselves;
* the address: its suffix (top-level domain) and its host give priors. A host's prior is its pages' text evidence
  smoothed towards that of its suffix, which is smoothed towards that of all pages (Dirichlet pseudo-counts).

The priors are grouped aggregates of text posteriors, pre-aggregated before the shuffle, so one host with a third
of all pages is one row per task. A page's own evidence is taken out of its host's prior before the fusion.

Defined results: a null or empty page has the evidence of its address alone; a null or unparsable address has
the general prior; an unknown declared language is no evidence; ties go to the first language in order; repeated
rows give repeated results; language names may hold any characters; columns other than the id, the address and the
page are not read, whatever their names. Without labelled documents there are no languages and ``language`` is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtally.llm._common import durable, text_slices
from tagtally.llm._words import mix

#: Rows of the labelled sample for each language (on average, by hash) and their bytes at most: the model's
#: training grows with the languages, not with the corpus.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 4 << 20
#: Trigram buckets; with more than ``TABLE_MOST / BUCKETS`` languages fewer, so that the table stays bounded.
BUCKETS, TABLE_MOST = 1 << 16, 1 << 24
#: Text evidence counts as so many independent trigrams at most.
TRIGRAMS_MOST = 40.0
#: Pseudo-counts of a suffix towards all pages, and of a host towards its suffix.
SUFFIX_PSEUDO, HOST_PSEUDO = 50.0, 10.0


def _width(languages: int) -> int:
    """Buckets of the table of so many languages: a power of two, 4,096 or more."""
    width = BUCKETS
    while width > 4096 and width * languages > TABLE_MOST:
        width //= 2
    return width


def _trigrams(data: np.ndarray, width: int = BUCKETS) -> np.ndarray:
    if len(data) < 3:
        return np.zeros(0, np.int64)
    d = data.astype(np.uint64)
    d[(data >= 65) & (data <= 90)] += np.uint64(32)
    return (mix(d[:-2] | d[1:-1] << np.uint64(8) | d[2:] << np.uint64(16)) % np.uint64(width)).astype(np.int64)


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities of trigram buckets (languages x buckets)."""
    lang, text = F.col(f"`{lang_column}`"), F.col(f"`{text_column}`")
    rows = docs.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.octet_length(text).alias("size"), F.xxhash64(F.col(f"`{id_column}`"), text).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    width = _width(len(langs))
    table = np.full((len(langs), width), 0.5)
    # Rows whose hash lies in their language's share: what reaches the driver is the sample and no more.
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, SAMPLE_ROWS / counts[lang])])[F.col("lang")]
    place, size = {x: i for i, x in enumerate(langs)}, dict.fromkeys(langs, 0)

    def learn(lang: str, text: str) -> None:
        data = np.frombuffer(text.encode(), np.uint8)
        for k in range(0, len(data), 1 << 20):  # trigrams of the whole text, a stretch of starts at a time
            np.add.at(table[place[lang]], _trigrams(data[k : k + (1 << 20) + 2], width), 1.0)

    sample = rows.where(F.pmod("h", F.lit(1 << 40)) < share * float(1 << 40))
    for r in sample.where(F.col("size") <= SAMPLE_BYTES).orderBy("lang", "h", "size").toLocalIterator():
        if size[r["lang"]] + r["size"] <= SAMPLE_BYTES:
            size[r["lang"]] += r["size"]
            learn(r["lang"], r["text"])
    untaught = [x for x in langs if not size[x]]
    if untaught:  # languages of which the sample has no text within the bytes learn from their shortest text, whole
        shortest = rows.where(F.col("lang").isin(untaught) & (F.col("size") > 0)).groupBy("lang").agg(F.min(F.struct("size", "h", "text")).alias("x"))
        for r in shortest.select("lang", "x.text").toLocalIterator():
            learn(r["lang"], r["text"])
    return langs, (np.log(table) - np.log(table.sum(1, keepdims=True))).astype(np.float32)


def page_text(html: str = "html"):
    """Text of a page: without scripts, styles, navigation, comments, tags and entities."""
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    for pattern in (r"(?is)<(script|style|nav|head)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>", r"&[#\w]+;"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _evidence(pages: DataFrame, langs: list[str], table: np.ndarray, id_column: str) -> DataFrame:
    held = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = held.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(langs)), np.float64)
            for first, data, offsets in text_slices(batch, "__text", 4 << 20):
                for i in range(len(offsets) - 1):
                    t = _trigrams(data[offsets[i] : offsets[i + 1]], table.shape[1])
                    if len(t):
                        out[first + i] = table[:, t].mean(1, dtype=np.float64) * min(len(t), TRIGRAMS_MOST)
            kept = [c for c in batch.schema.names if c != "__text"]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(langs)), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], flat], [*kept, "evidence"])

    html = F.col("`html`")
    url = F.lower(F.coalesce(F.col("`url`"), F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    declared = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = pages.select(F.col(f"`{id_column}`").alias("page"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), F.when(declared.isin(langs), declared).alias("declared"), page_text().alias("__text"))
    return rows.mapInArrow(run, "page long, host string, suffix string, declared string, evidence array<double>")


def _normal(logs: str) -> str:
    """SQL: an array of logarithms as probabilities."""
    e = f"transform({logs}, x -> exp(x - array_max({logs})))"
    return f"transform({e}, y -> y / aggregate({e}, 0D, (s, z) -> s + z))"


def identify(pages: DataFrame, docs: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Per page: id, ``language``, ``probability``, ``text_language``, ``declared``, ``host`` and ``host_pages``."""
    langs, table = train(docs)
    if not langs:
        return pages.select(id_column, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("string").alias("declared"), F.lit("").alias("host"), F.lit(0).cast("long").alias("host_pages"))
    k = len(langs)
    names = F.array(*[F.lit(x) for x in langs])  # values, never SQL text
    rows = _evidence(pages, langs, table, id_column).withColumn("soft", F.expr(_normal("evidence")))
    rows = durable(rows)
    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(k)]
    counts = F.array(*[F.col(f"s{i}") for i in range(k)])

    overall = rows.agg(*sums, F.count("*").alias("n")).first()  # one number for each language
    general = "array(" + ", ".join(f"{((overall[f's{i}'] or 0.0) + 1.0) / (overall['n'] + k)!r}D" for i in range(k)) + ")"
    suffixes = rows.groupBy("suffix").agg(*sums, F.count("*").alias("n"))
    suffixes = suffixes.select("suffix", F.expr(f"zip_with(array({', '.join(f's{i}' for i in range(k))}), {general}, (s, g) -> (s + {SUFFIX_PSEUDO}D * g) / (n + {SUFFIX_PSEUDO}D))").alias("by_suffix"))
    hosts = rows.groupBy("host", "suffix").agg(*sums, F.count("*").alias("host_pages")).join(suffixes, "suffix").select("host", "host_pages", counts.alias("sums"), "by_suffix")

    # P(declared | language): how declarations and text evidence go together, smoothed towards the declaration being right.
    pairs = rows.where("declared is not null").groupBy("declared").agg(*sums)
    table_rows = {r["declared"]: [r[f"s{i}"] for i in range(k)] for r in pairs.collect()}  # a row for each language
    together = np.array([[table_rows.get(d, [0.0] * k)[i] for i in range(k)] for d in langs]) + 0.5 + 4.5 * np.eye(k)
    given = np.log(together / together.sum(0, keepdims=True))
    known = [(d, given[i].tolist()) for i, d in enumerate(langs) if d in table_rows]
    weights = pages.sparkSession.createDataFrame(known, "declared string, by_declared array<double>")
    rows = rows.join(F.broadcast(weights), "declared", "left")  # a row for each language that pages declare
    rows = rows.withColumn("by_declared", F.coalesce("by_declared", F.array_repeat(F.lit(0.0), k)))

    rows = rows.join(hosts, "host")  # skewed hosts are split by the adaptive join
    rows = rows.withColumn("prior", F.expr(f"zip_with(zip_with(sums, soft, (s, x) -> greatest(0D, s - x)), by_suffix, (s, g) -> (s + {HOST_PSEUDO}D * g) / (host_pages - 1 + {HOST_PSEUDO}D))"))
    rows = rows.withColumn("fused", F.expr("zip_with(zip_with(evidence, by_declared, (x, y) -> x + y), prior, (x, p) -> x + ln(greatest(p, 1e-12D)))"))
    rows = rows.withColumn("posterior", F.expr(_normal("fused")))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return rows.select(F.col("page").alias(id_column), best("posterior").alias("language"), F.round(F.array_max("posterior"), 9).alias("probability"), best("evidence").alias("text_language"), "declared", "host", "host_pages")
