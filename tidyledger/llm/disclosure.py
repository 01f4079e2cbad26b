"""Personal data in cells, and terms whose company in the whole table gives it away."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, KEY, ROW, cut, keyed
from tidyledger.llm.decontaminate import _filter, _may_hold
from tidyledger.llm.words import Memo

# The kinds of protected entities, in order, and what they look like.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")

NEAR = 4  # words on either side of an entity that count as its company
REACH = 160  # characters on either side in which they are looked for
COUNTED = 200_000  # distinct terms a task counts before it passes them on
SPAN = "kind string, start int, stop int"


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: the name before it reaches back to the last match at most."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        sign = text.find("@", max(sign + 1, done))


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of all protected entities, in code points, by start, then kind as listed."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        digits = "".join(DIGITS.findall(match[0]))
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(match[0])) <= 15:
                found.append((match.start(), 3, match.end()))
    return [(KINDS[kind], start, stop) for start, kind, stop in sorted(found)]


def company(text: str, found: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, str, int, int]]:
    """(kind, entity, term, start, stop) of the words around each entity that belong to no entity themselves."""
    taken = bytearray(len(text))
    for _, start, stop in found:
        taken[start:stop] = b"\1" * (stop - start)
    for kind, start, stop in found:
        entity = xxhash.xxh64_intdigest(text[start:stop].lower()) >> 1
        low, high = max(0, start - REACH), min(len(text), stop + REACH)
        # A word at the edge of what is looked at may be cut and does not count.
        before = [m for m in WORD.finditer(text, low, start) if m.start() > low or low == 0][-NEAR:]
        after = [m for m in WORD.finditer(text, stop, high) if m.end() < high or high == len(text)][:NEAR]
        for word in before + after:
            if not any(taken[word.start() : word.end()]):
                yield kind, entity, word[0].lower(), word.start(), word.end()


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = [("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
    near = [("kind", pa.string()), ("entity", pa.int64()), ("term", pa.string())]
    near += [("start", pa.int32()), ("stop", pa.int32()), ("text", pa.int64())]
    names = [n for n, _ in near]
    for batch in batches:
        spans, nears = [], []
        for text in batch.column(2).to_pylist():
            found = entities(text)
            spans.append([dict(zip(("kind", "start", "stop"), f)) for f in found])
            own = xxhash.xxh64_intdigest(text) >> 1 if found else 0
            nears.append([dict(zip(names, (*c, own))) for c in company(text, found)])
        columns = [pa.array(spans, pa.list_(pa.struct(span))), pa.array(nears, pa.list_(pa.struct(near)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [KEY, ROW, "spans", "near"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of all words of a task's cells, summed up as far as memory allows."""

    def passed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
        )

    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(WORD.findall(text.lower()))
            if len(counts) >= COUNTED:
                yield passed_on(counts)
                counts = Counter()
    yield passed_on(counts)


def revealing_terms(near: DataFrame, counts: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(kind, term, share): terms that reveal a kind of entity, from all co-occurrences of the table.

    ``near`` has a row (kind, entity, term) per word in the company of an entity, ``counts`` the occurrences of each
    term. A term and an entity meet once, however often their text is copied. The pointwise mutual information of term
    and kind, over the information of the kind itself, is the share of the entity's information that the term
    discloses; terms at ``disclosure`` or more, met with ``support`` entities or more, reveal the kind.
    """
    met = near.select("kind", "entity", "term").distinct()
    kinds = met.groupBy("kind").agg(F.count(F.lit(1)).alias("of_kind"))
    together = met.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    total = counts.agg(F.sum("n")).first()[0] or 1
    joined = together.join(counts, "term").join(F.broadcast(kinds), "kind")  # as many rows as there are kinds
    of_term = F.greatest("n", "both")  # a word close to several entities met each of them
    lift = F.log(F.col("both") * float(total) / (of_term * F.col("of_kind")))
    share = lift / F.log(F.lit(float(total)) / F.col("of_kind"))
    return joined.select("kind", "term", share.alias("share")).where(F.col("share") >= disclosure)


def telling_terms(near: DataFrame, counts: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(term): terms that reveal one single entity, whatever its kind, such as the name beside an address.

    As ``revealing_terms``, but over distinct texts: a term and an entity met in ``support`` texts that differ or more,
    and the share is that of the entity's own information. ``counts`` has all occurrences, those in copies too, so
    where a text is copied often the share is taken low.
    """
    met = near.select("entity", "term", "text").distinct()
    together = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    texts = near.select("entity", "text").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    joined = together.join(counts, "term").join(texts, "entity")
    lift = F.log(F.col("both") * float(total) / (F.greatest("n", "both") * F.col("of_entity")))
    share = lift / F.log(F.lit(float(total)) / F.col("of_entity"))
    return joined.where(share >= disclosure).select("term").distinct()


def _placed(bits):
    """Where terms stand that may be among those of a filter, outside of protected entities."""
    place = pa.struct([("term", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        memo = Memo(lambda term: xxhash.xxh64_intdigest(term, 42))  # as Spark hashes a string
        for batch in batches:
            places = []
            for text in batch.column(1).to_pylist():
                words = list(WORD.finditer(text)) if held.any() else []
                terms = [w[0].lower() for w in words]
                hashes = np.fromiter(map(memo.__getitem__, terms), np.uint64, len(terms))
                hits = np.flatnonzero(_may_hold(held, hashes)).tolist()
                taken = entities(text) if hits else []
                places.append([
                    {"term": terms[n], "start": words[n].start(), "stop": words[n].end()}
                    for n in hits
                    if not any(a < words[n].end() and words[n].start() < b for _, a, b in taken)
                ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(place))], [KEY, "places"])

    return run


def _sanitised(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        cleaned = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            parts, at = [], 0
            for span in found or []:
                if span["start"] >= at:
                    parts += [text[at : span["start"]], f"[{span['kind']}]"]
                at = max(at, span["stop"])
            cleaned.append("".join([*parts, text[at:]]))
        yield pa.array(cleaned, pa.string())


def sanitised(cell: Column, spans: Column) -> Column:
    """Cell with each span replaced by its kind in brackets; a part of a span that an earlier one covers goes."""
    return F.arrow_udf(_sanitised, "string")(F.coalesce(cell, F.lit("")), spans)


def disclosing_cells(
    rows: DataFrame,
    cell: str,
    row_index: str = ROW,
    row_key: str | None = None,
    disclosure: float = 0.8,
    support: int = 5,
) -> DataFrame:
    """Spans of each cell to be generalised: protected entities, and terms beside them that reveal them.

    Returns one row per row of the table: (row_key, row_index, spans), spans being (kind, start, stop) in code points,
    sorted by start, then kind in the order email, ip, card, phone, term. Entities of a kind do not overlap; those of
    different kinds may. A term is a span where it stands within ``NEAR`` words of an entity of a kind it reveals: one
    it met ``support`` times or more, disclosing ``disclosure`` of the kind's information (see ``revealing_terms``). A
    term that reveals one single entity (see ``telling_terms``) is a span wherever it stands in any cell.
    ``sanitised`` puts kinds in place of spans. Missing, empty and clean cells have no spans. Repeated rows are judged
    each. Empty tables give no rows. Other columns are not read.

    Entities with their company are found in one pass and stored; all words of all cells are counted in another,
    summed per task before they are shuffled. Terms meet the stored company by a join, which adaptive execution splits
    where a term is very common. A filter of fixed size finds the places of terms that reveal a single entity in a last
    pass; a join decides.
    """
    cells = keyed(rows, cell, row_index, row_key)
    near = "array<struct<kind string, entity long, term string, start int, stop int, text long>>"
    scanned = cut(cells.mapInArrow(_scanned, f"{KEY} long, {ROW} long, spans array<struct<{SPAN}>>, near {near}"))
    company_of = scanned.select(KEY, F.inline("near"))
    words = cells.select(CELL).mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    words = cut(words)
    revealing = revealing_terms(company_of, words, disclosure, support)
    telling = cut(telling_terms(company_of, words, disclosure, support))
    bits = rows.sparkSession.sparkContext.broadcast(_filter(telling.select(F.xxhash64("term").alias("gram"))))
    places = cells.select(KEY, CELL).mapInArrow(_placed(bits), f"{KEY} long, places array<struct<term string, start int, stop int>>")
    anywhere = places.where(F.size("places") > 0).select(KEY, F.inline("places")).join(telling, "term", "left_semi")
    beside = company_of.join(revealing, ["kind", "term"])
    told = beside.select(KEY, "start", "stop").unionByName(anywhere.select(KEY, "start", "stop")).distinct()
    ranks = F.array(*map(F.lit, (*KINDS, TERM)))

    def ranked(start: Column, rank: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), rank.cast("int").alias("rank"), stop.alias("stop"))

    term = ranked(F.col("start"), F.lit(len(KINDS) + 1), F.col("stop"))
    terms = told.groupBy(KEY).agg(F.collect_list(term).alias("terms"))
    base = F.transform("spans", lambda s: ranked(s["start"], F.array_position(ranks, s["kind"]), s["stop"]))
    nothing = F.expr("cast(array() as array<struct<start int, rank int, stop int>>)")
    every = F.sort_array(F.concat(base, F.coalesce("terms", nothing)))
    named = F.transform(every, lambda s: F.struct(
        F.get(ranks, s["rank"] - 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")
    ))
    return scanned.join(terms, KEY, "left").select(KEY, ROW, named.alias("spans"))
