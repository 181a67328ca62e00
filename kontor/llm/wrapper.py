"""Main text of pages by wrapper induction per host.

1. Every page is read into blocks of text and a shape: its tree of slots.
2. The most frequent shape of a host is its wrapper.  Each other shape of the host is
   aligned with it by simple tree matching, once for all pages that have the shape.
3. Per host and slot of the wrapper, a slot whose most frequent text covers the share
   ``SHARE`` of the pages that have the slot is template where it has that text; all else varies (content).
4. The text of a page is its varying blocks without what is menu, header, footer, notice
   and the like by its markup.  Forms and classes of the layout don't exclude what holds
   most of a page's varying text.  Where pages mark the article, it is that article, and
   no block in it is taken for template, since several pages may hold one article.

Pages are never gathered by host: what is grouped is one small row per slot with
map-side combine, and pages meet the few shapes of their host in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm import dom
from kontor.session import checkpoint_cut

#: Share of characters in links from which a block outside a marked article is a menu.
LINKED = 0.5
#: Share of the pages with a slot that its most frequent text covers if the slot is template.
SHARE = 0.8
#: Pages that have to have the slot, or all pages of a smaller host; two at least.
FEW = 4
#: Blocks that a form or an element of the layout has to hold, besides most of the text, to be the page itself.
MANY = 3
#: Pages that are read before their rows are handed on.
PAGES = 64


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _read(pages: DataFrame, with_text: bool) -> DataFrame:
    """``host`` and ``shape`` of each page with its slots' hashes, or with its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES):
                part = batch.slice(i, PAGES)
                shapes, values = [], []
                for page in part.column("html"):
                    root, blocks = dom.read_page(page.as_py() or "")
                    shapes.append(dom.dump(root))
                    texts: dict[int, list[str]] = {}
                    for b in blocks:
                        if not b.around:
                            texts.setdefault(b.slot.index, []).append(b.text)
                    hashes = {s: xxhash.xxh64_intdigest("\n".join(t)) - (1 << 63) for s, t in texts.items()}
                    if with_text:
                        values.append([
                            {"slot": b.slot.index, "hash": hashes.get(b.slot.index), "text": b.text, "linked": b.linked, "around": b.around, "layout": b.layout, "main": b.main}
                            for b in blocks
                        ])
                    else:
                        values.append([{"slot": s, "hash": h} for s, h in hashes.items()])
                keep = ["page_id", "url", "host"] if with_text else ["host"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(shapes, pa.string()), pa.array(values, kind)], names=[*keep, "shape", "slots"])

    text_kind = pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64()), ("text", pa.string()), ("linked", pa.int32()), ("around", pa.int8()), ("layout", pa.list_(pa.int32())), ("main", pa.bool_())]))
    kind = text_kind if with_text else pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64())]))
    schema = (
        "page_id long, url string, host string, shape string, slots array<struct<slot: int, hash: long, text: string, linked: int, around: tinyint, layout: array<int>, main: boolean>>"
        if with_text else "host string, shape string, slots array<struct<slot: int, hash: long>>"
    )
    return pages.mapInArrow(run, schema)


def templates(pages: DataFrame) -> DataFrame:
    """``host``, ``shape`` and ``fixed``: the slots of the shape that are template, with their text's hash.  ``pages``: ``host``, ``html``."""
    slots = checkpoint_cut(_read(pages, with_text=False).select("host", "shape", F.xxhash64("shape").alias("code"), "slots"))
    # pages without text tell nothing, and copies of a page count once
    told = slots.where("size(slots) > 0").select("host", "code", "shape", "slots").distinct()
    shapes = checkpoint_cut(told.groupBy("host", "code").agg(F.count("*").alias("n"), F.min("shape").alias("shape")))
    wrappers = shapes.groupBy("host").agg(F.max(F.struct("n", "shape")).getField("shape").alias("wrapper"), F.sum("n").alias("pages"))
    pairs = shapes.join(wrappers.where("pages > 1"), "host").select("host", "code", "shape", "wrapper", "pages")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps = []
            for shape, wrapper in zip(batch["shape"], batch["wrapper"]):
                found = dom.align(dom.load(shape), dom.load(wrapper))
                maps.append([{"slot": s, "place": p} for s, p in sorted(found.items())])
            yield pd.DataFrame({"host": batch["host"], "code": batch["code"], "pages": batch["pages"], "map": maps})

    aligned = checkpoint_cut(
        pairs.mapInPandas(align, "host string, code long, pages long, map array<struct<slot: int, place: int>>").select(
            "host", "code", "pages", F.explode("map").alias("m")
        ).select("host", "code", "pages", "m.slot", "m.place")
    )
    values = told.select("host", "code", F.explode("slots").alias("s")).groupBy("host", "code", "s.slot", "s.hash").agg(F.count("*").alias("n"))
    texts = values.join(aligned, ["host", "code", "slot"]).groupBy("host", "place", "hash").agg(F.sum("n").alias("n"), F.max("pages").alias("pages"))
    places = texts.groupBy("host", "place").agg(F.max(F.struct("n", "hash")).alias("top"), F.sum("n").alias("n"), F.max("pages").alias("pages"))
    enough = (F.col("top.n") >= 2) & (F.col("n") >= F.least(F.lit(FEW), "pages"))
    judged = places.select("host", "place", "top.hash", (enough & (F.col("top.n") >= SHARE * F.col("n"))).alias("same"))
    telling = judged.groupBy("host").agg(F.bool_or(~F.col("same")).alias("varies")).where("varies")
    fixed = judged.where("same").join(telling, "host", "left_semi").join(aligned, ["host", "place"])
    fixed = fixed.groupBy("host", "code").agg(F.collect_set(F.struct("slot", "hash")).alias("fixed"))  # slots of one shape
    return fixed.join(shapes.select("host", "code", "shape"), ["host", "code"]).select("host", "shape", "fixed")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row: blocks of the article, joined by blank lines.

    Character references are decoded and white space within a block is one space.  A null
    or empty page, and a page without content, has an empty text; a page that ends within
    a tag ends before it.  A null address is a host of its own.  Rows that repeat are
    read like any others; other columns are not read.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    known = templates(slim.select("host", "html"))
    read = _read(slim, with_text=True).withColumn("code", F.xxhash64("shape"))
    known = known.select(F.col("host").alias("_h"), F.xxhash64("shape").alias("_c"), "fixed")
    met = read.join(known, (F.col("host") == F.col("_h")) & (F.col("code") == F.col("_c")), "left")
    slots, fixed = F.col("slots"), F.coalesce("fixed", F.array().cast("array<struct<slot: int, hash: bigint>>"))
    unlinked = lambda b: b["linked"] < LINKED * F.length(b["text"])
    varies = lambda b: unlinked(b) & ~F.exists(fixed, lambda f: (f["slot"] == b["slot"]) & f["hash"].eqNullSafe(b["hash"]))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))

    def page_itself(inside: Column) -> Column:
        """Numbers of the forms and layout elements that hold most of the varying text."""
        holds = lambda c: F.filter(inside, lambda b: F.array_contains(b["layout"], c))
        most = F.filter(
            F.array_distinct(F.flatten(F.transform(inside, lambda b: b["layout"]))),
            lambda c: (2 * chars(holds(c)) > chars(inside)) & (F.size(holds(c)) >= MANY),
        )
        outside = F.filter(inside, lambda b: F.size(b["layout"]) == 0)
        return F.when(2 * chars(outside) < chars(inside), most).otherwise(F.array().cast("array<int>"))

    def tried(free: Column) -> Column:
        tries = [
            F.filter(free, lambda b: b["main"]),
            F.filter(free, varies),
            # nothing else is left: what varies although a form, a class of the layout or comments hold it
            F.filter(slots, lambda b: (b["around"] == 0) & b["main"]),
            F.filter(slots, lambda b: (b["around"] == 0) & varies(b)),
            F.filter(free, unlinked),
            F.filter(slots, lambda b: (b["around"] < dom.OUTSIDE) & varies(b)),
        ]
        return F.coalesce(*(F.nullif(F.array_join(F.transform(t, lambda b: b["text"]), "\n\n"), F.lit("")) for t in tries))

    def searched() -> Column:
        most = F.array(page_itself(F.filter(slots, lambda b: (b["around"] == 0) & varies(b))))
        free = lambda m: F.filter(slots, lambda b: (b["around"] == 0) & (F.size(F.array_except(b["layout"], m)) == 0))
        return F.transform(F.transform(most, free), tried)[0]

    # the usual page, without a layout around or in its article, needs no search
    plain = F.exists(slots, lambda b: (b["around"] == 0) & b["main"]) & ~F.exists(slots, lambda b: (b["around"] == 0) & b["main"] & (F.size(b["layout"]) > 0))
    article = F.filter(slots, lambda b: (b["around"] == 0) & b["main"])
    text = F.coalesce(F.when(plain, F.array_join(F.transform(article, lambda b: b["text"]), "\n\n")).otherwise(searched()), F.lit(""))
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
