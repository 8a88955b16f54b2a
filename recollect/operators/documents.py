"""Completeness of documents, jobs, garbage and transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.predicates import collapse
from recollect.sources.shared import saved, ship


def gaps(pages: DataFrame) -> DataFrame:
    """document_id, pages, missing of each kind, is_complete, first_gap.

    ``pages`` has document_id and a boolean a kind: rendered, transcribed, embedded, stored.
    The first gap is the earliest phase that any page lacks.
    """
    kinds = ["rendered", "transcribed", "embedded", "stored"]
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), *(F.count_if(~F.col(k)).alias(f"not_{k}") for k in kinds))
    first = F.lit(None).cast("string")
    for k in reversed(kinds):
        first = F.when(F.col(f"not_{k}") > 0, k).otherwise(first)
    return counts.withColumn("is_complete", first.isNull()).withColumn("first_gap", first)


def final_status(complete: Column, stored: Column) -> Column:
    return F.when(complete, "completed").when(stored > 0, "partial").otherwise("failed")


def orphaned(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs (job_id, document_id, a row a reference) whose documents all exist and are completed."""
    state = jobs.join(documents, "document_id", "left").select("job_id", F.col("status").eqNullSafe("completed").alias("done"))
    return state.groupBy("job_id").agg(F.bool_and("done").alias("all_done"), F.count(F.lit(1)).alias("references")).filter("all_done").drop("all_done")


def evict(cache: DataFrame, budget: int, parts: int = 1024) -> DataFrame:
    """Files to drop, oldest first, until the rest fit: key, size, mtime.

    What stays is the newest files whose sizes sum to at most ``budget``. Sums run over slices
    of the time range, then inside a slice.
    """
    low, high = cache.agg(F.min("mtime")).scalar(), cache.agg(F.max("mtime")).scalar()
    sliced = cache.select("*", low.alias("lo"), high.alias("hi")).withColumn("slice", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("mtime") - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1))).otherwise(F.lit(0)).cast("int")).drop("lo", "hi")
    newer = Window.partitionBy(F.lit(0)).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("slice").agg(F.sum("size").alias("s")).select("slice", F.coalesce(F.sum("s").over(newer), F.lit(0)).alias("after"))
    inside = Window.partitionBy("slice").orderBy(F.desc("mtime"), F.desc("key"))
    kept = sliced.withColumn("upto", F.sum("size").over(inside)).join(F.broadcast(sums), "slice")  # a row a slice
    return kept.filter(F.col("after") + F.col("upto") > budget).select("key", "size", "mtime")


#: Labels of a page's regions, what a transcript leaves out, and the markup's forms.
LABELS = ("text", "title", "sub_title", "header", "footer", "table", "image", "figure", "figure_title", "caption", "equation", "page_number")
DROPPED = ("header", "page_number")
REFERRED = r"<\|ref\|>(.*?)<\|/ref\|>\s*<\|det\|>(.*?)<\|/det\|>"
DETECTED = r"<\|det\|>\s*([A-Za-z_][A-Za-z0-9_ -]*)?\s*(\[\[?[^\]]*\]\]?)?\s*<\|/det\|>"
MARKER = r"<\|(ref|det)\|>"
RESIDUE = r"<[|｜][^<>\n]{0,64}?[|｜]>"


def _cleaned(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, RESIDUE, ""), r"^\s+|\s+$", "")


def _region(label: Column, box: Column | None, content: Column) -> Column:
    numbers = F.lit(None).cast("array<int>") if box is None else F.regexp_extract_all(box, F.lit(r"-?\d+"), F.lit(0)).cast("array<int>")
    return F.struct(label.alias("label"), F.when(F.size(numbers) >= 4, F.slice(numbers, 1, 4)).alias("box"), content.alias("content"))


def _up_to(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, 1)


def _after(x: Column, mark: str) -> Column:
    return F.regexp_replace(x, f"^[^{mark}]*{mark}", "")


def grounded(raw: Column) -> Column:
    """array<struct<label, box, content>>: a page's regions in order, from a reader's grounded markup.

    A region is ``<|ref|>label<|/ref|><|det|>box<|/det|>`` or ``<|det|>label box<|/det|>`` and the
    text up to the next marker. A reference to anything but a label is text itself, and so is what
    stands before the first marker or after one that was cut off. A box has four numbers or is
    null; other special tokens are taken out, blanks trimmed, empty texts left out.
    """
    known = F.array(*map(F.lit, LABELS))
    plain = lambda x: F.filter(F.array(_region(F.lit("text"), None, _cleaned(x))), lambda r: r["content"] != "")
    named = lambda x: F.replace(F.lower(_cleaned(x)), F.lit(" "), F.lit("_"))

    def parts(rest: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(rest, "(?s)" + DETECTED, "\x01D$1\x02$2\x03"), MARKER, "\x01P<|$1|>")
        return F.split(marked, "\x01")

    def later(part: Column) -> Column:
        label = named(F.regexp_replace(_up_to(part, "\x02"), "^D", ""))
        box = _after(_up_to(part, "\x03"), "\x02")
        found = _region(F.when(label == "", "text").otherwise(label), box, _cleaned(_after(part, "\x03")))
        return F.when(part.startswith("D") & part.contains("\x03"), F.array(found)).otherwise(plain(F.regexp_replace(part, "^P", "")))

    def unmarked(rest: Column) -> Column:
        pieces = parts(rest)
        return F.concat(plain(pieces[0]), F.flatten(F.transform(F.slice(pieces, 2, F.size(pieces)), later)))

    def referred(segment: Column) -> Column:
        head, rest = _up_to(segment, "\x03"), _after(segment, "\x03")
        text, box = F.regexp_replace(_up_to(head, "\x02"), "^R", ""), _after(head, "\x02")
        label, pieces = named(text), parts(rest)
        region = F.array(_region(F.when(label == "figure", "image").otherwise(label), box, _cleaned(pieces[0])))
        other = F.filter(F.array(_region(F.lit("text"), box, _cleaned(text))), lambda r: r["content"] != "")
        after = F.flatten(F.transform(F.slice(pieces, 2, F.size(pieces)), later))
        return F.when(F.array_contains(known, label), F.concat(region, after)).otherwise(F.concat(other, unmarked(rest)))

    clean = F.translate(raw, "\x01\x02\x03", "")
    segments = F.split(F.regexp_replace(clean, "(?s)" + REFERRED, "\x01R$1\x02$2\x03"), "\x01")
    return F.concat(unmarked(segments[0]), F.flatten(F.transform(F.slice(segments, 2, F.size(segments)), referred)))


def rendered(found: Column, dropped: tuple[str, ...] = DROPPED, captions: Column | None = None) -> Column:
    """A page's regions as text: titles are headings, figures numbered marks with their ``captions`` (a map by number), ``dropped`` labels left out."""
    kept = F.filter(found, lambda r: ~r["label"].isin(*dropped))
    figures = F.filter(F.transform(kept, lambda r, i: F.when(r["label"] == "image", i)), lambda i: i.isNotNull())

    def block(r: Column, i: Column) -> Column:
        number = F.array_position(figures, i).cast("int")
        caption = captions[number] if captions is not None else F.lit(None)
        mark = F.concat(F.lit("[figure "), number.cast("string"), F.coalesce(F.concat(F.lit(": "), caption), F.lit("")), F.lit("]"))
        text = F.when(r["content"] == "", F.lit(None)).when(r["label"] == "title", F.concat(F.lit("## "), r["content"])).otherwise(r["content"])
        return F.when(r["label"] == "image", F.concat_ws("\n\n", mark, text)).otherwise(text)

    return F.regexp_replace(F.array_join(F.transform(kept, block), "\n\n"), r"^\s+|\s+$", "")


def _plain(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"(</tr>)\s+(<tr[\s>])", "$1$2"))


def _located(found: Column) -> Column:
    """Regions that were found, or none if one of them has no box."""
    return F.when(F.exists(found, lambda r: r["box"].isNull()), F.array().cast("array<int>")).otherwise(F.transform(found, lambda r: r["id"]))


def placed(found: Column) -> Column:
    """struct<joined, pieces>: a page's regions joined, white space aside, and each one's number (from 0), box, begin and end in that."""
    numbered = F.transform(found, lambda r, i: F.struct(i.alias("id"), r["box"].alias("box"), _plain(r["content"]).alias("t")))
    none = F.array().cast("array<struct<id: int, box: array<int>, s: int, e: int>>")
    start = F.struct(none.alias("pieces"), F.lit(0).alias("at"))

    def add(seen: Column, r: Column) -> Column:
        end = seen["at"] + F.length(r["t"])
        one = F.struct(r["id"].alias("id"), r["box"].alias("box"), seen["at"].alias("s"), end.alias("e"))
        return F.struct(F.array_append(seen["pieces"], one).alias("pieces"), (end + 1).alias("at"))

    kept = F.filter(numbered, lambda r: r["t"] != "")
    return F.transform(F.array(kept), lambda ps: F.struct(F.array_join(F.transform(ps, lambda r: r["t"]), " ").alias("joined"), F.aggregate(ps, start, add, lambda seen: seen["pieces"]).alias("pieces")))[0]


def quoted_in(rows: DataFrame, quote: Column, page: Column, places: Column, name: str = "regions") -> DataFrame:
    """As ``quoted_regions``, of a ``page`` whose white space is collapsed and the ``places`` that ``placed`` gives of its regions."""
    out = rows.withColumns({"_needle": _plain(quote), "_page": page, "_joined": places["joined"], "_pieces": places["pieces"]})
    out = out.withColumn("_at", F.position("_needle", "_joined") - 1)
    touched = F.filter("_pieces", lambda x: (x["s"] < F.col("_at") + F.length("_needle")) & (x["e"] > F.col("_at")))
    times = (F.length("_page") - F.length(F.replace("_page", "_needle", F.lit("")))) / F.length("_needle")
    once = (F.col("_needle") != "") & (times == 1) & (F.col("_at") >= 0) & (F.position("_needle", "_joined", F.col("_at") + 2) == 0)
    out = out.withColumn(name, F.when(once, _located(touched)).otherwise(F.array().cast("array<int>")))
    return out.drop("_needle", "_page", "_joined", "_pieces", "_at")


def quoted_regions(rows: DataFrame, quote: Column, text: Column, found: Column, name: str = "regions") -> DataFrame:
    """``rows`` with ``name``: numbers (from 0) of the regions that a quote stands in, white space aside, across neighbouring ones.

    None unless the quote is once in the page's ``text`` and once in its regions joined, and all
    regions it touches have a box.
    """
    return quoted_in(rows, quote, _plain(text), placed(found), name)


def table_rows(html: Column) -> Column:
    """array<array<string>>: the cells of each row of one HTML table, markup taken out, white space collapsed; none of tables in tables or with parts that don't close."""
    count = lambda tag: F.regexp_count(html, F.lit(tag))
    sound = (count(r"(?i)<table\b") == 1) & (count(r"(?i)</table>") == 1) & (count(r"(?i)<tr\b") == count(r"(?i)</tr>")) & (count(r"(?i)<t[dh]\b") == count(r"(?i)</t[dh]>")) & (count(r"(?i)<(script|style)\b") == 0)
    body = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)<br\b[^>]*>", " "), r"<[^>]*>", "")
    text = lambda x: collapse(F.replace(F.replace(F.replace(F.replace(F.replace(body(x), F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), text))
    return F.when(sound, cells).otherwise(F.array().cast("array<array<string>>"))


def quoted_rows(quote: Column, found: Column) -> Column:
    """Number of the one table region with one row of exactly the quote's cells, which ``|`` parts, if it has a box.

    A cell whose reader took currency for mathematics may have ``\\(`` or ``\\)`` that the quote
    hasn't; digits, signs and percentages must agree.
    """
    cells = F.transform(F.split(quote, r"\|"), collapse)
    money = r"^\$[+-]?\d[\d,]*(\.\d+)?(\s*\(\d+(\.\d+)?%\))?$"

    def same(a: Column, q: Column) -> Column:
        bare = F.trim(F.replace(F.replace(a, F.lit("\\("), F.lit("")), F.lit("\\)"), F.lit("")))
        return (a == q) | ((a.contains("\\(") | a.contains("\\)")) & (bare == F.when(q.rlike(money), F.substring(q, 2, 1 << 20)).otherwise(q)))

    def times(r: Column) -> Column:
        return F.size(F.filter(table_rows(r["content"]), lambda row: (F.size(row) == F.size(cells)) & F.forall(F.zip_with(row, cells, same), lambda ok: ok)))

    tables = F.transform(found, lambda r, i: F.struct(i.alias("id"), r["box"].alias("box"), F.when(r["label"] == "table", times(r)).otherwise(0).alias("n")))
    hits = F.filter(tables, lambda r: r["n"] > 0)
    return F.when((F.size(cells) > 1) & (F.size(hits) == 1) & (hits[0]["n"] == 1), _located(hits)).otherwise(F.array().cast("array<int>"))


def quoted_figures(quote: Column, found: Column) -> Column:
    """Numbers of the image regions that the marks ``[figure n]`` in a quote name; none if one of them doesn't exist or has no box."""
    asked = F.regexp_extract_all(quote, F.lit(r"\[figure ([^\]]*)\]"), F.lit(1))
    images = F.filter(F.transform(found, lambda r, i: F.struct(i.alias("id"), r["box"].alias("box"), r["label"].alias("label"))), lambda r: r["label"] == "image")
    sound = F.forall(asked, lambda n: F.coalesce(n.rlike("^[1-9][0-9]{0,8}$") & (n.try_cast("int") <= F.size(images)), F.lit(False)))
    picked = F.filter(F.transform(images, lambda r, i: F.struct(r["id"].alias("id"), r["box"].alias("box"), F.array_contains(asked, (i + 1).cast("string")).alias("in"))), lambda r: r["in"])
    return F.when((F.size(asked) > 0) & sound, _located(picked)).otherwise(F.array().cast("array<int>"))


def arrivals(found: DataFrame, now: Column, ttl: int = 900) -> DataFrame:
    """id, decision of each arrival: found has status, started (epoch seconds), first_gap of what is known of it."""
    flight = F.col("status").isin("processing", "pending", "pending_fetch") & (F.col("started") > now - ttl)
    decision = F.when(F.col("status").isNull(), "fresh").when(flight, "in_flight").when(F.col("status") == "completed", "complete").otherwise(F.concat(F.lit("resume:"), F.coalesce("first_gap", F.lit("render"))))
    return found.select("id", decision.alias("decision"))


def page_text(transcript: Column, page_no: Column, file: Column) -> Column:
    """A page's transcript, or what stands for an empty one. Fixed value: the text of the placeholder."""
    return F.coalesce(F.nullif(transcript, F.lit("")), F.format_string("[Visual page %d of %s]", page_no + 1, file))


def garbage(rows: DataFrame, used: DataFrame, key: str, now: Column, grace: str) -> DataFrame:
    """Rows (key, mtime) that nothing uses and that are older than the grace."""
    return rows.filter(F.col("mtime") < now - F.expr(f"interval {grace}")).join(used, key, "left_anti")


#: Characters of quotes that one pass over the documents looks for.
PASS = 2_000_000


def locate(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id, doc_id, begin_at, times, is_unique of each quote and document that holds it.

    White space is collapsed on both sides. Quotes of any length are found, also inside words, by
    an automaton of all quotes, in one pass over the documents; no text is shuffled. More than
    PASS characters of quotes take another pass for each further PASS. An empty quote is nowhere.
    """
    spark = ship(docs.sparkSession)
    asked = quotes.select("item_id", collapse(F.col("quote")).alias("quote")).filter("quote <> ''")
    ranges = F.pmod(F.xxhash64("quote"), F.lit(1 << 20))
    size = asked.agg(F.coalesce(F.sum(F.length("quote")), F.lit(0))).first()[0]
    passes = max(1, -(-2 * size // PASS)) if size > PASS else 1
    asked = saved(asked.withColumn("pass", F.floor(ranges * passes / (1 << 20)).cast("int")), "quotes")
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), collapse(F.col("text")).alias("text")).filter("text is not null")

    def run(sent) -> Callable:  # noqa: ANN001 - a broadcast of (quote, place) pairs
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for quote in sent.value:
                automaton.add_word(quote, quote)
            if sent.value:
                automaton.make_automaton()
            for b in batches:
                out: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    first: dict[str, list[int]] = {}
                    for end, quote in automaton.iter(text.as_py()) if sent.value else ():
                        begin = end - len(quote) + 1
                        seen = first.setdefault(quote, [begin, 0, -1])
                        if begin > seen[2]:  # occurrences that don't overlap count
                            seen[1], seen[2] = seen[1] + 1, end
                    out += [(doc_id, q, b_, n) for q, (b_, n, _) in first.items()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "quote", "begin_at", "times"])

        return look

    found = None
    for n in range(passes):
        sent = spark.sparkContext.broadcast([r.quote for r in asked.filter(F.col("pass") == n).select("quote").distinct().collect()])  # PASS characters
        one = clean.mapInArrow(run(sent), "doc_id long, quote string, begin_at long, times long")
        found = one if found is None else found.union(one)
    hits = saved(found.join(asked.select("item_id", "quote"), "quote").drop("quote"), "quotes-found")
    totals = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return hits.join(totals, "item_id").select("item_id", "doc_id", "begin_at", "times", ((F.col("documents") == 1) & (F.col("times") == 1)).alias("is_unique"))
