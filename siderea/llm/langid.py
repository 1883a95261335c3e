"""Language identification by Bayesian fusion of evidence.

For each page and language the logarithms add up of
- the text's likelihood: byte trigrams of the visible text under each language's trigram model, counted over all documents with a
  known language, damped by DAMPING as neighbouring trigrams tell the same;
- the likelihood of the language that the markup declares, and of the address suffix (the host's last label);
- the prior of its host, smoothed towards its domain's (the last two labels), which is smoothed towards all pages'.
The last three are learned from the pages themselves by grouped sums of the text's posteriors; a page's own share is taken out
of the sums before they judge it. Sums are by key, partial before the shuffle, so a host with a third of all pages is no burden.

Null html is an empty page, null urls have the empty host. A page without any evidence gets the prior of all pages. Without
documents of known language lang is null and confidence 0. One row comes back for each page row, repeated or null page_ids
included. Documents without a language or text teach nothing. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderea.llm.common import read_table, save, tune

BUCKET_BITS = 15
DAMPING = 1 / 8
SMOOTH = 5.0
_COMMENT = "<!--"
_HIDING = re.compile(r"<(?:!--|(script|style|noscript|template)\b)", re.I)
_ENDING = {k: re.compile("</" + k, re.I) for k in ("script", "style", "noscript", "template")}
_TAG = re.compile(r"<[^>]*>")
_OPENING = re.compile(r"<(?:html|meta)\b", re.I)
_ATTRIBUTE = re.compile(r"""(?<![a-z:-])([a-z:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_CODE = re.compile(r"[A-Za-z]{2,3}\b")
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def shown(page: str, noscript: bool) -> str:
    """page without comments, scripts, styles, templates and, unless noscript, noscript elements; what isn't closed stays. One pass: each
    kind of end is looked for until it isn't found once, and never again."""
    parts, at, ended = [], 0, set()
    for m in _HIDING.finditer(page):
        if m.start() < at:
            continue
        kind = (m[1] or _COMMENT).lower()
        if kind in ended or (noscript and kind == "noscript"):
            continue
        if kind == _COMMENT:
            after = page.find("-->", m.end()) + 3
            found = after > 2
        else:
            end = _ENDING[kind].search(page, m.end())
            after = page.find(">", end.end()) + 1 if end else 0
            found = after > 0
        if not found:
            ended.add(kind)
            continue
        parts.append(page[at : m.start()])
        at = after
    return " ".join([*parts, page[at:]]) if parts else page


def visible(page: str) -> str:
    """Without tags; a "<" that nothing closes is text."""
    page = shown(page, False)
    last = page.rfind(">") + 1  # up to here every "<" is closed, so that one pass takes all tags
    return html.unescape(_TAG.sub(" ", page[:last]) + page[last:])


def declared(page: str) -> str:
    """The language of the html element, else of a content-language meta; they may stand behind any length of comments and scripts."""
    return _declared(shown(page, True))


def _declared(page: str) -> str:
    meta, end = "", -1
    for m in _OPENING.finditer(page):
        if m.start() < end:
            continue
        end = page.find(">", m.end())
        if end < 0:
            break
        found = {a[0].lower(): (a[1] or a[2] or a[3]).strip() for a in _ATTRIBUTE.findall(page, m.end(), end)}
        if m[0].lower() == "<html":
            code = _CODE.match(found.get("lang", "")) or _CODE.match(found.get("xml:lang", ""))
            if code:
                return code[0].lower()
        elif not meta and found.get("http-equiv", "").lower() == "content-language" and (code := _CODE.match(found.get("content", ""))):
            meta = code[0].lower()
    return meta


def address(url: str) -> tuple[str, str, str]:
    """Host, domain and suffix, "" where there are none."""
    try:
        host = (urlsplit(url).hostname or "").rstrip(".").lower()
    except ValueError:
        return "", "", ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def trigrams(text: str) -> np.ndarray:
    a = np.frombuffer(b" ".join(f" {text} ".lower().encode("utf-8", "replace").translate(_LETTERS).split()), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    return (((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


class Trigrams:
    """languages, and table: log-probabilities (buckets, languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + 0.5
        self.table = np.log(p / p.sum(axis=0, keepdims=True)).astype(np.float32)

    def likelihoods(self, text: str) -> np.ndarray:
        g = trigrams(text)
        s = self.table[g].sum(axis=0, dtype=np.float64) * DAMPING
        return s - s.max()


def train(docs: DataFrame) -> Trigrams:
    """docs (lang, text). At most 2 ** BUCKET_BITS rows for each language come to the driver."""
    tune(docs.sparkSession)
    known = docs.select("lang", "text").filter("lang is not null and text is not null")
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())  # names of languages, not data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = {x: i for i, x in enumerate(languages)}, {}  # a row of counts for each language a task meets, 64 at most at once

        def told() -> Iterator[pa.RecordBatch]:
            for k, c in counts.items():
                bucket = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), k)), pa.array(bucket), pa.array(c[bucket])], ["l", "b", "n"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if at[lang] not in counts and len(counts) == 64:
                    yield from told()
                counts[at[lang]] = counts.get(at[lang], 0) + np.bincount(trigrams(text), minlength=1 << BUCKET_BITS)
        yield from told()

    got = known.mapInArrow(run, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    if got.num_rows:
        counts[got["b"].to_numpy(), got["l"].to_numpy()] = got["n"].to_numpy()
    return Trigrams(languages, counts)


KEYS = ("declared", "suffix", "domain", "host")


def evidence(pages: DataFrame, model: Trigrams) -> DataFrame:
    """page_id, host, domain, suffix, declared and post: the text's posterior under equal priors."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = []
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                body = shown(page or "", True)
                p = np.exp(m.likelihoods(visible(body)))
                rows.append((*address(url or ""), _declared(body), (p / p.sum()).tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["page_id", "host", "domain", "suffix", "declared", "post"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, host string, domain string, suffix string, declared string, post array<double>")


def fuse(post: np.ndarray, sums: dict[str, np.ndarray], whole: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Posteriors of pages (rows) by language. sums: for each of KEYS the summed posteriors of the page's key; whole: of all pages."""
    rest = np.maximum(whole[None, :] - post, 0)
    n = rest.sum(axis=1, keepdims=True)
    out = np.log(np.maximum(post, 1e-300))
    for key in ("declared", "suffix"):
        s = np.maximum(sums[key] - post, 0)
        out += np.log((s + smooth * (s.sum(axis=1, keepdims=True) + 1) / (n + 1)) / (rest + smooth))
    prior = (rest + 1) / (n + rest.shape[1])
    for key in ("domain", "host"):
        s = np.maximum(sums[key] - post, 0)
        prior = (s + smooth * prior) / (s.sum(axis=1, keepdims=True) + smooth)
    out += np.log(prior)
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def identify(pages: DataFrame, model: Trigrams) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence for each of pages (page_id, url, html)."""
    spark, k = tune(pages.sparkSession), len(model.languages)
    if not k:
        return pages.select("page_id", *(F.lit(None).cast("string").alias(c) for c in ("host", "declared", "text_lang", "lang")), F.lit(0.0).alias("confidence"))
    seen = save(evidence(pages, model), "evidence")
    totals = [F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(k)]
    whole = np.array(seen.agg(*totals).collect()[0])
    joined = seen
    for key in KEYS:
        sums = seen.groupBy(key).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(k)]).alias(f"{key}_sum"))
        joined = joined.join(sums, key)
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            grid = {c: b.column(c).flatten().to_numpy().reshape(-1, k) for c in ("post", *(f"{key}_sum" for key in KEYS))}
            p = fuse(grid["post"], {key: grid[f"{key}_sum"] for key in KEYS}, whole)
            text = [languages[i] if q.max() > q.min() else None for i, q in zip(grid["post"].argmax(axis=1).tolist(), grid["post"], strict=True)]
            lang = [languages[i] for i in p.argmax(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("declared"), pa.array(text, pa.string()), pa.array(lang, pa.string()), pa.array(p.max(axis=1))], ["page_id", "host", "declared", "text_lang", "lang", "confidence"])

    kind = pages.schema["page_id"].dataType.simpleString()
    cols = ["page_id", "host", "declared", "post", *(f"{key}_sum" for key in KEYS)]
    return joined.select(*cols).mapInArrow(run, f"page_id {kind}, host string, declared string, text_lang string, lang string, confidence double")


def op4_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(read_table(spark, sf_dir, "documents").select("lang", "text"))
    return identify(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
