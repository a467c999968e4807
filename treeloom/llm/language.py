"""Language of web pages by Bayesian fusion: text, declared language, address suffix, host.

log P(language | page) = text + declaration + suffix + host, up to a constant:

* text: a naive Bayes model of character trigrams (hashed to ``CELLS``), tempered, as trigrams overlap;
* declaration: P(declared tag | language), suffix: P(last label of the host | language), both from grouped sums of
  the pages' text posteriors, smoothed;
* host: P(language | host), from grouped sums without the page's own share, shrunk to the suffix's distribution and
  that to the whole's.

The text model is fitted on at most ``SAMPLE`` documents of each language in hash order (the documented bound).  The
grouped sums cover all pages, combine map-side, and a host's rows meet its one row of sums in a join that Spark can
split where a host is hot.  Null or empty pages have no text evidence; the other evidence decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import at_exit, discard, maybe_broadcast, prepare, stash, utf8_buffer

CELLS, SAMPLE, SLICES = 1 << 14, 1500, 64
#: Weight of one trigram's evidence; pseudo-counts of tags and suffixes, of a suffix's and of a host's prior.
TEMPER, TAG_PRIOR, SUFFIX_PRIOR, HOST_PRIOR = 0.3, 1.0, 5.0, 3.0

_OPENS = re.compile(r"(?i)<(?:(script|style|noscript|template)\b|!--)")
_CLOSES = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"(?i)<html\b[^>]*>")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,3})")
_META = re.compile(r"(?i)<meta\b[^>]*>")
_CONTENT = re.compile(r"(?i)content\s*=\s*[\"']?\s*([a-z]{2,3})")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_ENTITY = re.compile(r"&[#\w]{1,12};")


def _visible(html: str) -> str:
    """The page without hidden elements and comments; linear: a closing mark that is missing is looked for once."""
    out, at, missing = [], 0, set()
    for m in _OPENS.finditer(html):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in missing:
            continue
        if kind:
            close = _CLOSES[kind].search(html, m.end())
            end = close.end() if close else -1
        else:
            end = html.find("-->", m.end())
            end = end + 3 if end >= 0 else -1
        if end < 0:
            missing.add(kind)
            continue
        out.append(html[at : m.start()])
        at = end
    out.append(html[at:])
    return " ".join(out)


def page_text(html: str | None) -> str:
    """Visible text of a page, without entities (they say nothing about a language)."""
    text = _visible(html or "")
    cut = text.rfind(">") + 1  # before it every tag ends
    return _ENTITY.sub(" ", _TAG.sub(" ", text[:cut]) + text[cut:])


def declared_language(html: str | None) -> str:
    """The language that the first html tag or else a meta tag declares, or "none"."""
    head = (html or "")[: (html or "").rfind(">") + 1]
    tag = _HTML.search(head)
    found = _LANG.search(tag[0]) if tag else None
    if not found:
        for m in _META.finditer(head):
            at = m[0].lower().find("content-language")
            found = _CONTENT.search(m[0], at + len("content-language")) if at >= 0 else None
            if found:
                break
    return found[1].lower() if found else "none"


def trigram_cells(texts: list[str]):
    """Cells of all trigrams of letters, and the row of each.  Digits, signs and white space become one space."""
    data, offsets = utf8_buffer(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    d = np.where(letter, data, 32).astype(np.uint64)
    h = (d[:-2] * np.uint64(65599) + d[1:-1]) * np.uint64(65599) + d[2:]
    cell = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
    rows = np.searchsorted(offsets, np.arange(len(cell)), "right") - 1
    ok = (offsets[rows + 1] >= np.arange(len(cell)) + 3) & (letter[:-2].astype(int) + letter[1:-1] + letter[2:] >= 2)
    return cell[ok], rows[ok]


def fit_text(docs: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram cell | language), from docs (doc_id, text, lang)."""
    from pyspark.sql import Window

    ranked = docs.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # the lowest hashes of each language: first within slices of a language, then of what the slices leave
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    sliced = ranked.withColumn("slice", F.pmod("h", F.lit(SLICES))).withColumn("place", place("lang", "slice")).where(F.col("place") <= most)
    picked = stash(sliced.withColumn("place", place("lang")).where(F.col("place") <= most).select("doc_id", "lang"), "languages")
    langs = sorted(r[0] for r in picked.select("lang").distinct().collect())  # one row a language
    if not langs:
        return ["und"], np.zeros((1, CELLS))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist())
            cell, rows = trigram_cells(batch.column(1).to_pylist())
            for name in set(lang.tolist()):
                total[name] = total.get(name, 0) + np.bincount(cell[lang[rows] == name], minlength=CELLS)
        for name, c in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": [c.astype(np.int64).tobytes()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    def add(key, group):
        c = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"lang": [key[0].as_py()], "counts": [c.tobytes()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    rows = docs.select("doc_id", "text").join(maybe_broadcast(picked), "doc_id").select("lang", "text").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    discard(picked)
    table = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    c = np.array([table.get(x, np.zeros(CELLS, np.int64)) for x in langs]) + 0.5
    return langs, np.log(c / c.sum(1, keepdims=True))


def fuse(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, suffix, host) of pages (page_id, url, html)."""
    spark = pages.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast((table * TEMPER).astype(np.float64))
    n = len(langs)

    def evidence(batches):
        logs = model.value
        known = set(langs)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                html = batch.column(2).to_pylist()
                cell, rows = trigram_cells([page_text(x) for x in html])
                score = np.stack([np.bincount(rows, logs[j][cell], minlength=len(html)) for j in range(n)], 1).astype(np.float64)
                score -= score.max(1, keepdims=True)
                post = np.exp(score)
                post /= post.sum(1, keepdims=True)
                declared, suffix, host = [], [], []
                for u, x in zip(batch.column(1).to_pylist(), html):
                    tag = declared_language(x)
                    declared.append(tag if tag in known or tag == "none" else "other")
                    h = _HOST.match(u or "")
                    name = h.group(1).lower() if h else ""
                    host.append(name)
                    suffix.append(name.rpartition(".")[2])
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (declared, suffix, host)), *(pa.array(np.ascontiguousarray(score[:, j])) for j in range(n)), *(pa.array(np.ascontiguousarray(post[:, j])) for j in range(n))], names=["page_id", "declared", "suffix", "host", *(f"s{j}" for j in range(n)), *(f"p{j}" for j in range(n))])

    columns = ", ".join([*(f"s{j} double" for j in range(n)), *(f"p{j} double" for j in range(n))])
    rows = stash(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(evidence, f"page_id long, declared string, suffix string, host string, {columns}"), "evidence")
    at_exit(spark, rows._stash_path)
    sums = lambda key, to: rows.groupBy(key).agg(*(F.sum(f"p{j}").alias(f"{to}{j}") for j in range(n)))
    whole = rows.agg(*(F.sum(f"p{j}") for j in range(n))).first()
    total = [float(x or 0) + 1.0 for x in whole]
    tags, suffixes, hosts = sums("declared", "d"), sums("suffix", "x"), sums("host", "h")
    # declarations take n + 2 values, so their sums are broadcast; suffixes and hosts are left to the planner
    joined = rows.join(F.broadcast(tags), "declared").join(suffixes, "suffix").join(hosts, "host")
    mass, log = sum(total), {}
    for j in range(n):
        share = F.lit(total[j] / mass)
        xs = sum((F.col(f"x{i}") - F.col(f"p{i}") for i in range(1, n)), F.col("x0") - F.col("p0"))
        hs = sum((F.col(f"h{i}") - F.col(f"p{i}") for i in range(1, n)), F.col("h0") - F.col("p0"))
        of_suffix = (F.col(f"x{j}") - F.col(f"p{j}") + SUFFIX_PRIOR * share) / (xs + SUFFIX_PRIOR)
        of_host = (F.col(f"h{j}") - F.col(f"p{j}") + HOST_PRIOR * of_suffix) / (hs + HOST_PRIOR)
        told = F.log((F.col(f"d{j}") - F.col(f"p{j}") + TAG_PRIOR) / (total[j] - F.col(f"p{j}") + TAG_PRIOR * (n + 2)))
        log[j] = F.col(f"s{j}") + told + F.log(F.greatest(of_host, F.lit(1e-9)))
    scored = joined.select("page_id", "declared", "suffix", "host", *(log[j].alias(f"l{j}") for j in range(n)), *(F.col(f"s{j}") for j in range(n)))
    pick = lambda p: F.element_at(F.array(*map(F.lit, langs)), F.array_position(F.array(*(F.col(f"{p}{j}") for j in range(n))), F.array_max(F.array(*(F.col(f"{p}{j}") for j in range(n))))).cast("int"))
    top = F.array_max(F.array(*(F.col(f"l{j}") for j in range(n))))
    confidence = 1 / sum((F.exp(F.col(f"l{j}") - top) for j in range(1, n)), F.exp(F.col("l0") - top))
    return scored.select("page_id", pick("l").alias("lang"), confidence.alias("confidence"), pick("s").alias("text_lang"), "declared", "suffix", "host")


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    langs, table = fit_text(docs)
    return fuse(pages, langs, table)
