"""Tables of terms met with whole texts: one scan of a text finds every term, however many there are.

The terms form an automaton (a trie with failure links) that goes with the tasks; a text
is read once, and what comes back is in proportion to what was found. A table beyond
SLICE terms is dealt into several automata, each of bounded size, and the finds are put
together again. Rules, regions and countries are booleans and folds over the finds of one
text, made where it is read: a task holds the finds of one text and AT_ONCE rows besides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of one automaton; some hundred bytes a term.
SLICE = 100_000
#: Rows, and finds within rows, that a task gathers before it hands them on.
AT_ONCE = 20_000
LOWER_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
CASED_EDGE = LOWER_EDGE | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PLAIN_MARKS = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": " ", " ": " "})
#: No combining character is below U+0300; those that text mostly has are told by the pattern alone.
MARKS, HIGH = re.compile("[\u0300-\u034e\u0350-\u036f]+"), re.compile("[\u0370-\U0010ffff\u034f]+")
WORDS = re.compile(r"[^\W_]+")
#: Before and after a run of letters and digits.
MARKED, RUN = "\x00\x01", "\x00\\g<0>\x01"
FIELDS = ("start", "end", "size", "label", "kind", "term")
FOUND = "array<struct<start:int,end:int,size:int,label:string,kind:string,term:string>>"


def plain_text(text: str | None) -> str:
    """accents folded, quotes and dashes plain, one blank for each run of white space."""
    out = text or ""
    if not out.isascii():
        out = MARKS.sub("", unicodedata.normalize("NFKD", out))
        out = HIGH.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), out)
        for mark, plain in PLAIN_MARKS.items():
            out = out.replace(chr(mark), plain)
    return " ".join(out.split())


class Terms:
    """Finds terms in texts. A term is (label, kind, term); `kind` may tell how it counts.

    `whole`: an end of a term that is a letter or digit touches no other (of a to z and
    digits, or with `cased` of A to Z too). `plural`: an s or es may follow, and belongs
    to the find. Without `cased` terms and texts are compared in lower case.
    """

    def __init__(self, terms: list[tuple[str, str, str]], whole: bool = True, plural: bool = False, cased: bool = False, fold: Callable[[str | None], str] = plain_text):
        self.whole, self.plural, self.cased, self.fold = whole, plural, cased, fold
        self.edge = CASED_EDGE if cased else LOWER_EDGE
        by_term: dict[str, list[tuple[str, str]]] = {}
        for label, kind, term in terms:
            key = self.read(term)
            if key:
                by_term.setdefault(key, []).append((label, kind))
        self.by_term = {key: sorted(set(of)) for key, of in by_term.items()}
        self.run = re.compile("[A-Za-z0-9]+" if cased else "[a-z0-9]+")
        # Runs of what `edge` knows are marked in texts, and in the terms that begin and end with such a run or with a sign, so that nothing within a run is met.
        fits = lambda key: whole and all(c in self.edge or not c.isalnum() for c in (key[0], key[-1])) and not any(m in key for m in MARKED)
        forms: dict[str, list[tuple[str, int]]] = {}
        for key in filter(fits, self.by_term):
            for tail in ("", "s", "es") if plural and key[-1].isalnum() else ("",):
                forms.setdefault(self.run.sub(RUN, key + tail), []).append((key, len(key) + len(tail)))
        self.marked = self._automaton(forms)
        self.odd = self._automaton({key: key for key in self.by_term if not fits(key)})
        self._plain: ahocorasick.Automaton | None = None

    def _automaton(self, terms: dict[str, object]) -> ahocorasick.Automaton | None:
        trie = ahocorasick.Automaton()
        for written, value in terms.items():
            trie.add_word(written, value)
        if terms:
            trie.make_automaton()
        return trie if terms else None

    def read(self, text: str | None) -> str:
        out = self.fold(text)
        return out if self.cased else out.lower()

    def _end(self, text: str, end: int) -> int:
        """Where a term ends that was found up to `end`, or -1 where it runs on."""
        free = lambda k: k >= len(text) or text[k] not in self.edge
        if free(end):
            return end
        if self.plural:
            for tail in ("s", "es"):
                if text.startswith(tail, end) and free(end + len(tail)):
                    return end + len(tail)
        return -1

    def _span(self, text: str, last: int, key: str) -> tuple[int, int] | None:
        """Where `key`, found up to `last`, starts and ends; None where it is no whole term."""
        start, end = last + 1 - len(key), last + 1
        if self.whole:
            if key[0].isalnum() and start and text[start - 1] in self.edge:
                return None
            end = self._end(text, end) if key[-1].isalnum() else end
        return None if end < 0 else (start, end)

    def _read_plainly(self, trie: ahocorasick.Automaton | None, text: str) -> Iterator[tuple[int, int, str]]:
        for last, key in trie.iter(text) if trie else ():
            if at := self._span(text, last, key):
                yield *at, key

    def _met(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, term) of every find in a text read."""
        if any(m in text for m in MARKED):
            self._plain = self._plain or self._automaton({key: key for key in self.by_term})
            yield from self._read_plainly(self._plain, text)
            return
        yield from self._read_plainly(self.odd, text)
        if not self.marked:
            return
        text = self.run.sub(RUN, text)
        seen = marks = 0
        for last, forms in self.marked.iter(text):
            marks += text.count(MARKED[0], seen, last + 1) + text.count(MARKED[1], seen, last + 1)
            seen = last + 1
            for key, size in forms:
                yield seen - marks - size, seen - marks, key

    def find(self, text: str | None) -> list[tuple[int, int, int, str, str, str]]:
        """(start, end, length without plural, label, kind, term) of every find, by start, the longest first."""
        found = [(start, end, len(key), label, kind, key) for start, end, key in self._met(self.read(text)) for label, kind in self.by_term[key]]
        return sorted(found, key=lambda x: (x[0], -x[2], x[5], x[3], x[4]))

    def parts(self, text: str | None) -> set[tuple[str, str]]:
        """(label, kind) of the terms that a text has, however often."""
        seen, out = set(), set()
        for _, _, key in self._met(self.read(text)):
            if key not in seen:
                seen.add(key)
                out.update(self.by_term[key])
        return out


def _handed_on(batches: Iterable[pa.RecordBatch], rows_of: Callable[[object], Iterable[tuple]], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The first column of each row with each of the rows that its second one gives."""
    for batch in batches:
        ids, rows, held = [], [], 0

        def full(ids=ids, rows=rows, batch=batch):
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            out = [batch.column(0).take(pa.array(ids, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))]
            return pa.RecordBatch.from_arrays(out, names=["id", *kinds])

        for i, value in enumerate(batch.column(1)):
            for row in rows_of(value.as_py()):
                ids.append(i)
                rows.append(row)
                held += 1 + sum(len(x) for x in row if isinstance(x, list))
                if held >= AT_ONCE:
                    yield full()
                    ids.clear()
                    rows.clear()
                    held = 0
        yield full()


def _scans(texts: DataFrame, terms: DataFrame, rows_of: Callable[[Terms, str | None], Iterable[tuple]], schema: str, kinds: dict[str, pa.DataType], id_col: str = "id", text_col: str = "text", slice_: int = SLICE, **how: object) -> list[DataFrame]:
    """id and the columns of `schema`: what `rows_of` makes of each text, once a slice of the terms."""
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    table = terms.select("label", "kind", "term").filter("term is not null").distinct()
    slices = max(1, -(-table.count() // slice_))

    def scan(which: int) -> DataFrame:
        mine = table.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == which)
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # about `slice_` terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Terms(shared.value, **how)
            return _handed_on(batches, lambda text: rows_of(matcher, text), kinds)

        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}")

    return [scan(which) for which in range(slices)]


def found_terms(texts: DataFrame, terms: DataFrame, **how: object) -> DataFrame:
    """(id, found): each row's finds by start, the longest first, as FOUND; rows without finds have none.

    terms: label, kind, term. Null texts count as empty, null and blank terms find
    nothing, rows that repeat a term count once. With one slice ids may repeat and no
    shuffle is made; with several, the finds of an id are put together.
    """
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in FIELDS[:3]] + [(x, pa.string()) for x in FIELDS[3:]]))
    out, *more = _scans(texts, terms, lambda m, text: [([dict(zip(FIELDS, x, strict=True)) for x in m.find(text)],)], f"found {FOUND}", {"found": kind}, **how)
    if not more:
        return out
    for x in more:
        out = out.union(x)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["size"] != b["size"], b["size"] - a["size"]).when(a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).when(a["kind"] < b["kind"], -1).otherwise(1)
    return out.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("found")).withColumn("found", F.array_sort("found", order))


def folded_finds(texts: DataFrame, terms: DataFrame, fold: Callable[[list[tuple]], Iterable[tuple]], *names: str, **how: object) -> DataFrame:
    """id and the columns `names`, all strings: the rows that `fold` makes of the finds of each text, as `Terms.find` gives them.

    With one slice no find leaves the task that made it; with several they are put together before the fold.
    """
    schema, kinds = ", ".join(f"{x} string" for x in names), dict.fromkeys(names, pa.string())
    scans = _scans(texts, terms, lambda m, text: fold(m.find(text)), schema, kinds, **how)
    if len(scans) == 1:
        return scans[0]
    found = found_terms(texts, terms, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _handed_on(batches, lambda found: fold([tuple(x.values()) for x in found]), kinds)

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, {schema}")


def of_kind(finds: list[tuple], *kinds: str) -> list[tuple]:
    return [x for x in finds if x[4] in kinds]


def consumed(finds: list[tuple]) -> list[tuple]:
    """Of the finds, those that a scan from left to right takes, the longest first at each place; what it takes it does not read again."""
    out, at = [], 0
    for x in finds:
        if x[0] >= at:
            out.append(x)
            at = x[1]
    return out


def clear_of(finds: list[tuple], cut: list[tuple]) -> list[tuple]:
    """The finds that no span of `cut` overlaps, whose spans are apart and in order, as `consumed` gives them."""
    if not cut:
        return finds
    starts = [x[0] for x in cut]
    return [x for x in finds if not (k := bisect_left(starts, x[1])) or cut[k - 1][1] <= x[0]]


def named_regions(finds: list[tuple]) -> Iterator[tuple[str, str | None, str | None]]:
    """(tag, strong, weak): the regions of which a text has terms, with the first of each kind."""
    left = clear_of([x for x in finds if x[4] != "strip"], consumed(of_kind(finds, "strip")))
    by_label: dict[str, list[tuple]] = {}
    for x in left:
        by_label.setdefault(x[3], []).append(x)
    for label, mine in by_label.items():
        told = clear_of(of_kind(mine, "strong", "weak"), consumed(of_kind(mine, "exclude")))
        strong, weak = (next((x[5] for x in told if x[4] == kind), None) for kind in ("strong", "weak"))
        if strong is not None or weak is not None:
            yield label, strong, weak


def named_countries(finds: list[tuple]) -> list[tuple[str]]:
    """The countries of a text's finds."""
    names = clear_of(of_kind(finds, "name"), consumed(of_kind(finds, "strip")))
    return [(label,) for label in dict.fromkeys(x[3] for x in consumed(names))]


def geo_signals(texts: DataFrame, terms: DataFrame, weak_buckets: DataFrame, bucket_col: str = "bucket", **how: object) -> DataFrame:
    """(id, tag, term): the regions that a text names, with the first term that tells.

    terms: label (a region; any for "strip"), kind ("strong", "weak", "exclude", "strip"),
    term. Phrases to strip, then those that a region excludes, are taken out of the text
    before its terms are looked for. A weak term counts only where no strong one does and
    the text's bucket is one of the region's weak ones (weak_buckets: label, bucket); it
    is shown as "weak:term".
    """
    told = folded_finds(texts, terms, named_regions, "tag", "strong", "weak", plural=True, **how)
    told = told.join(texts.select("id", F.col(bucket_col).alias("bucket_")), "id")
    weak = weak_buckets.select(F.col("label").alias("tag"), F.col("bucket").alias("bucket_"), F.lit(True).alias("may")).distinct()
    told = told.join(weak, ["tag", "bucket_"], "left")
    return told.select("id", "tag", F.coalesce("strong", F.when(F.col("may"), F.concat(F.lit("weak:"), "weak"))).alias("term")).filter("term is not null")


def countries(texts: DataFrame, terms: DataFrame, **how: object) -> DataFrame:
    """(id, country): the countries that a text names, longer names before the shorter ones within them.

    terms: label (a country; any for "strip"), kind ("name" or "strip"), term.
    """
    return folded_finds(texts, terms, named_countries, "country", plural=True, **how)


def found_labels(texts: DataFrame, terms: DataFrame, **how: object) -> DataFrame:
    """(id, label): the labels of which each text has a term, once each."""
    out, *more = _scans(texts, terms, lambda m, text: [(x,) for x in {label for label, _ in m.parts(text)}], "label string", {"label": pa.string()}, **how)
    for x in more:
        out = out.union(x)
    return out.distinct() if more else out


def rule_parts(texts: DataFrame, rules: DataFrame, **how: object) -> DataFrame:
    """(id, rule, parts): the rules of which a text has a term, with the parts whose terms it has."""
    terms = rules.select(F.col("rule").alias("label"), F.col("part").alias("kind"), "term")

    def rows_of(matcher: Terms, text: str | None) -> list[tuple[str, list[str]]]:
        by_rule: dict[str, list[str]] = {}
        for rule, part in sorted(matcher.parts(text)):
            by_rule.setdefault(rule, []).append(part)
        return list(by_rule.items())

    out, *more = _scans(texts, terms, rows_of, "rule string, parts array<string>", {"rule": pa.string(), "parts": pa.list_(pa.string())}, **how)
    for x in more:
        out = out.union(x)
    return out.groupBy("id", "rule").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"))


def matched_rules(texts: DataFrame, rules: DataFrame, **how: object) -> DataFrame:
    """(id, rule): the rules that a text matches: one of its terms, one of its pairs where it has any, none it excludes.

    rules: rule, part ("term", "pair" or "exclude"), term.
    """
    paired = rules.filter("part = 'pair'").select("rule", F.lit(True).alias("paired")).distinct()
    has = lambda part: F.array_contains("parts", part)
    met = rule_parts(texts, rules, **how).filter(has("term") & ~has("exclude")).join(F.broadcast(paired), "rule", "left")
    return met.filter(F.col("paired").isNull() | has("pair")).select("id", "rule")


def folded_words(text: str | None) -> str:
    """words without accents in lower case, 's dropped and plurals folded, a blank between and around."""
    out = unicodedata.normalize("NFKD", text or "")
    out = "".join(c for c in out if not unicodedata.category(c).startswith("M")).lower().replace("’", "'").replace("'s", "").replace("'", "")
    words = "".join(c if c.isalnum() else " " for c in out).split()
    fold = lambda w: w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w
    again = (fold(w) for w in words)
    return " " + " ".join(w[:-2] + "y" if len(w) > 3 and w.endswith("ie") else w for w in again) + " " if words else ""


def plain_words(text: str | None) -> str:
    """Words in lower case, a blank between and around, so that terms of words are whole words."""
    words = WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def topic_tags(texts: DataFrame, rules: DataFrame, bucket_topics: DataFrame, implies: DataFrame, default: str = "world", **how: object) -> DataFrame:
    """(id, tag): topics by the bucket, by keywords, by rules of several parts, and what they imply.

    texts: id, bucket, text. rules: rule (the tag), part, term, where a tag follows from
    any "keyword"; any "strong"; a "name"; a "named" together with a "context"; a "weak"
    without a "negative"; a "state" together with an "occasion". bucket_topics: bucket,
    tag. implies: tag, also. A text of a bucket that has no tag gets `default`.
    """
    has = lambda part: F.array_contains("parts", part)
    told = has("keyword") | has("strong") | has("name") | (has("named") & has("context")) | (has("weak") & ~has("negative")) | (has("state") & has("occasion"))
    by_text = rule_parts(texts, rules, **how).filter(told).select("id", F.col("rule").alias("tag"), F.lit(0).alias("n"))
    by_bucket = texts.select("id", "bucket").join(F.broadcast(bucket_topics), "bucket").select("id", "tag", F.lit(0))
    rows = by_text.union(by_bucket).union(texts.select("id", F.lit(None).cast("string"), F.col("bucket").isNotNull().cast("int")))
    more = implies.groupBy("tag").agg(F.collect_set("also").alias("also"))
    tags = rows.join(F.broadcast(more), "tag", "left").select("id", "n", F.array_compact(F.concat(F.array("tag"), F.coalesce("also", F.array().cast("array<string>")))).alias("tags"))
    each = tags.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"), F.sum("n").cast("int").alias("n"))
    return each.select("id", F.explode(F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array_repeat(F.lit(default), F.col("n")))).alias("tag"))
