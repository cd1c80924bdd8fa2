"""Schemaless availability payloads to quotes.

A document is parsed once and walked to the bottom, whatever its depth; every object becomes a row of
member texts and member types, and everything after that is column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pricemesh.functions.parse import money
from pricemesh.operators.cleaning import first_arrivals

# Accepted spellings per field and source profile, in the order they are tried.
ALIASES = {
    "qp": {
        "total": ["totalAmount", "total", "grandTotal", "totalFare", "amount"],
        "base": ["baseFare", "base", "baseAmount", "fareAmount", "netFare"],
        "taxes": ["taxAmount", "taxes", "totalTax", "tax"],
        "udf": ["udf", "userDevelopmentFee", "UDF", "userDevFee"],
        "convenience": ["convenienceFee", "conv", "convFee", "serviceFee"],
        "other": ["otherCharges", "surcharge", "misc", "otherFees"],
    },
    "sg": {
        "total": ["totalAmount", "totalFare", "total", "grandTotal", "amount", "totalPrice"],
        "base": ["baseFare", "base", "baseAmount", "fareAmount", "netFare", "adultBaseFare"],
        "taxes": ["taxAmount", "taxes", "totalTax", "tax", "taxAndFees"],
        "udf": ["udf", "UDF", "userDevelopmentFee", "userDevFee", "airportDevelopmentFee"],
        "convenience": ["convenienceFee", "convFee", "conv", "serviceFee", "handlingFee"],
        "other": ["otherCharges", "surcharge", "misc", "otherFees", "fuelSurcharge"],
    },
}
FLIGHT_KEYS = ["flightNumber", "flightNo", "number", "designator", "flightId"]
DEPARTURE_KEYS = ["departureTime", "departure", "std", "departureDateTime", "depTime"]
BRAND_KEYS = ["fareType", "brandName", "productClass", "fareBrand", "fareFamily"]
STOP_KEYS = ["stops", "numberOfStops", "stopCount"]
# End of fixed values.
DOC = ["raw_id"]


class Number(str):
    """A JSON number, kept as it is written."""


def _kind(value) -> str:
    if isinstance(value, Number):
        return "DECIMAL"
    kinds = {str: "STRING", bool: "BOOLEAN", dict: "OBJECT", list: "ARRAY"}
    return kinds.get(type(value), "VOID")


def _text_of(value, sort_keys: bool = False) -> str | None:
    """Text of a value: strings bare, numbers as written, containers as JSON, their keys sorted if asked."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"

    # A stack of its own, no recursion: what is to be written next lies on top, texts as Number.
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, (dict, list)):
            parts = [Number("{" if isinstance(v, dict) else "[")]
            for i, x in enumerate(sorted(v) if sort_keys and isinstance(v, dict) else v):
                parts += [Number(",")] if i else []
                parts += [Number(json.dumps(x, ensure_ascii=False) + ":"), v[x]] if isinstance(v, dict) else [x]
            stack += reversed([*parts, Number("}" if isinstance(v, dict) else "]")])
        else:
            out.append(v if isinstance(v, Number) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _member(value) -> str | None:
    """Text of an object's member. A container is written with its own scalar members only: what lies deeper has rows of
    its own, and the texts of all members of a document stay as long as the document, however deep it is."""
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if not isinstance(v, (dict, list))}
    elif isinstance(value, list):
        value = [v for v in value if not isinstance(v, (dict, list))]
    return _text_of(value)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_LITERALS = {"t": ("true", True), "f": ("false", False), "n": ("null", None), "N": ("NaN", Number("NaN")), "I": ("Infinity", Number("Infinity"))}


def _read_deep(text: str):
    """The document as json.loads reads it, without recursion: open containers lie on a stack.

    Every step reads one value, or one key, or closes a container; ValueError where the text is no JSON.
    """
    at, size = _SPACE.match(text).end(), len(text)
    stack: list = []
    root = key = None
    while True:
        # A value is due.
        if at >= size:
            raise ValueError("a value is missing")
        c = text[at]
        opened = c in "{["
        if opened:
            value, at = ({} if c == "{" else []), at + 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif c in _LITERALS and text.startswith(_LITERALS[c][0], at):
            value, at = _LITERALS[c][1], at + len(_LITERALS[c][0])
        elif text.startswith("-Infinity", at):
            value, at = Number("-Infinity"), at + 9
        elif number := _NUMBER.match(text, at):
            value, at = Number(number[0]), number.end()
        else:
            raise ValueError("no value")
        if not stack:
            root = value
        elif isinstance(stack[-1], dict):
            stack[-1][key] = value
        else:
            stack[-1].append(value)
        if opened:
            stack.append(value)
        # Close what ends here, then read on to the next value.
        fresh = opened
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                if at < size:
                    raise ValueError("text after the document")
                return root
            top, c = stack[-1], text[at : at + 1]
            if c == ("}" if isinstance(top, dict) else "]"):
                stack.pop()
                at, fresh = at + 1, False
                continue
            if not fresh:
                if c != ",":
                    raise ValueError("a comma is missing")
                at = _SPACE.match(text, at + 1).end()
            if isinstance(top, dict):
                if text[at : at + 1] != '"':
                    raise ValueError("a key is missing")
                key, at = json.decoder.scanstring(text, at + 1, True)
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("a colon is missing")
                at = _SPACE.match(text, at + 1).end()
            break


def _parsed(text: str | None):
    """The document, whatever its depth, or None where the text is no JSON object or array."""
    try:
        root = json.loads(text or "", parse_int=Number, parse_float=Number, parse_constant=Number)
    except ValueError:
        return None
    except RecursionError:  # deeper than the fast reader goes
        try:
            root = _read_deep(text)
        except ValueError:
            return None
    return root if isinstance(root, (dict, list)) else None


def _walk(root) -> Iterator[dict]:
    """Every object below the root in document order, however deep; a stack of its own, no recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
        members = node.values() if isinstance(node, dict) else node
        stack += reversed([m for m in members if isinstance(m, (dict, list))])


def _sound(text: str | None) -> str | None:
    """The text with lone halves of surrogate pairs, which JSON can spell but no table can hold, replaced."""
    return text if text is None or text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


#: Objects handed on at once.
OBJECTS = 1 << 14


def objects(documents: DataFrame) -> DataFrame:
    """Every JSON object of every document: its place among them in document order, the text of its
    members and their types, both as maps (a container's text holds its own scalar members only).

    Each document is parsed once, in Arrow batches where it is read, and walked to the bottom.
    """
    keep = [c for c in documents.columns if c != "payload"]
    maps = T.MapType(T.StringType(), T.StringType())
    schema = documents.select(*keep).schema.add("place", T.LongType()).add("members", maps).add("kinds", maps)
    arrow_maps = pa.map_(pa.string(), pa.string())

    def table(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        of, places, members, kinds = zip(*found)
        at = pa.array(of, pa.int64())
        columns = [pa.array(places, pa.int64()), pa.array(members, arrow_maps), pa.array(kinds, arrow_maps)]
        # The text itself is not repeated for its objects.
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[1:]], *columns], [*keep, "place", "members", "kinds"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for i, text in enumerate(batch.column(0).to_pylist()):
                root = _parsed(text)
                for place, node in enumerate(_walk(root)) if root is not None else ():
                    named = [(_sound(k), v) for k, v in node.items()]
                    found.append((i, place, [(k, _sound(_member(v))) for k, v in named], [(k, _kind(v)) for k, v in named]))
                    if len(found) >= OBJECTS:
                        yield table(batch, found)
                        found = []
            if found:
                yield table(batch, found)

    return documents.select("payload", *keep).mapInArrow(run, schema)


def unreadable(documents: DataFrame) -> DataFrame:
    """Documents whose payload is no JSON object or array; they have no objects and so no quotes.

    Read by the same parser as objects(), so no document that gave one is listed.
    """
    at = documents.columns.index("payload")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_parsed(t) is None for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def without_quotes(documents: DataFrame) -> DataFrame:
    """Documents that gave no quote, with every key seen in them: what a new profile has to learn."""
    found = quotes(documents).select("raw_id").distinct()
    silent = documents.join(found, "raw_id", "left_anti")
    return silent.join(observed_keys(silent), "raw_id", "left")


def _first(keys: Column | list[str], read) -> Column:
    """First key, in order, from which `read` gets a value. One lambda keeps generated code small."""
    names = F.array(*[F.lit(k) for k in keys]) if isinstance(keys, list) else keys
    return F.get(F.filter(F.transform(names, read), lambda x: x.isNotNull()), F.lit(0))


def _text(key: Column) -> Column:
    return F.element_at("members", key)


def _is(key: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(F.element_at("kinds", key), F.lit(pattern)), F.lit(False))


NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def first_amount(aliases: Column | list[str]) -> Column:
    """First alias that reads as money; booleans and containers do not."""
    return _first(aliases, lambda k: F.when(_is(k, "^STRING") | _is(k, NUMBER), money(_text(k))))


def by_profile(source: Column, field: str) -> Column:
    """Amount of a field under the alias table of the row's source profile."""
    names = None
    for profile, table in ALIASES.items():
        choice = F.array(*[F.lit(a) for a in table[field]])
        names = F.when(source == profile, choice) if names is None else names.when(source == profile, choice)
    return first_amount(names)


def flight_number(carrier: Column) -> Column:
    """Carrier + number, from text, number or a nested object."""

    def normal(raw: Column) -> Column:
        n = F.replace(F.upper(F.trim(raw)), F.lit(" "), F.lit(""))
        bare = F.regexp_replace(n, F.concat(F.lit("^["), carrier, F.lit("]+")), F.lit(""))
        return F.when(F.startswith(n, carrier), n).otherwise(F.concat(carrier, bare))

    def read(k: Column) -> Column:
        inner = F.coalesce(*[F.get_json_object(_text(k), f"$.{i}") for i in ("flightNumber", "number", "identifier")])
        return (
            F.when(_is(k, "^STRING") & (F.trim(_text(k)) != ""), normal(_text(k)))
            .when(_is(k, NUMBER), F.concat(carrier, _text(k).try_cast("double").try_cast("bigint").cast("string")))
            .when(_is(k, "^OBJECT") & inner.isNotNull(), normal(inner))
        )

    return _first(FLIGHT_KEYS, read)


def departure_at(day: Column) -> Column:
    """Departure from an ISO timestamp or a bare HH:MM on the departure date."""

    def read(k: Column) -> Column:
        s = F.trim(_text(k))
        iso = F.when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}")), s.try_cast("timestamp_ntz"))
        clock = F.regexp_extract(s, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int")
        minute = F.regexp_extract(s, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
        bare = F.when(
            (clock < 24) & (minute < 60),
            F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), clock, minute, F.lit(0)),
        )
        return F.when(_is(k, "^STRING"), F.coalesce(iso, bare))

    return _first(DEPARTURE_KEYS, read)


def brand() -> Column:
    return _first(BRAND_KEYS, lambda k: F.when(_is(k, "^STRING") & (F.trim(_text(k)) != ""), F.trim(_text(k))))


def stops() -> Column:
    """Stop count, zero when absent or unreadable."""
    return F.coalesce(_first(STOP_KEYS, lambda k: _text(k).try_cast("double").try_cast("int")), F.lit(0))


def residual_taxes(total: Column, base: Column, taxes: Column, parts: list[Column]) -> tuple[Column, Column]:
    """Taxes as the residual when only they are missing; a negative one voids the base too."""
    zero = F.lit(0).cast("decimal(18,2)")
    rest = total - sum((F.coalesce(p, zero) for p in parts), base)
    derive = base.isNotNull() & taxes.isNull()
    new_taxes = F.when(derive, F.when(rest >= 0, rest)).otherwise(taxes)
    new_base = F.when(derive & (rest < 0), None).otherwise(base)
    return new_base, new_taxes


def quotes(documents: DataFrame) -> DataFrame:
    """Non-stop quotes of every payload, the first object per (flight, departure).

    `documents`: raw_id, source (alias profile), carrier, origin, destination, scrape_date,
    departure_date, payload.
    """
    node = objects(documents).withColumn("total", by_profile(F.col("source"), "total"))
    node = node.filter((F.col("total") > 0) & (stops() == 0))
    rest = [f for f in ALIASES["qp"] if f != "total"]
    node = node.withColumns({f: by_profile(F.col("source"), f) for f in rest})
    node = node.withColumns(
        {
            "flight_number": flight_number(F.col("carrier")),
            "departure_at": departure_at(F.col("departure_date")),
            "fare_brand": brand(),
        }
    ).drop("members", "kinds")
    unique = first_arrivals(node, ["raw_id", "flight_number", "departure_at"], F.col("place")).drop("copies")
    base, taxes = residual_taxes(
        F.col("total"), F.col("base"), F.col("taxes"), [F.col("udf"), F.col("convenience"), F.col("other")]
    )
    money_type = "decimal(12,2)"
    return unique.select(
        "raw_id", F.col("source").alias("source_code"), "origin", "destination", "carrier", "scrape_date",
        "departure_date", F.col("total").cast(money_type).alias("total_fare"), "flight_number", "departure_at",
        F.lit(0).alias("stops"), F.lit("ECONOMY").alias("fare_class"), "fare_brand",
        base.cast(money_type).alias("base_fare"), taxes.cast(money_type).alias("taxes"),
        F.col("udf").cast(money_type).alias("udf"), F.col("convenience").cast(money_type).alias("convenience_fee"),
        F.col("other").cast(money_type).alias("other_charges"),
        F.when(base.isNull(), F.array(F.lit("no_component_split"))).otherwise(F.array().cast("array<string>")).alias(
            "quality_flags"
        ),
    )


def observed_keys(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Keys seen anywhere in each document, for payloads no profile recognised; all unless limited."""
    keys = objects(documents).select("raw_id", F.explode(F.map_keys("members")).alias("key")).distinct()
    listed = F.array_sort(F.collect_set("key"))
    return keys.groupBy("raw_id").agg((F.slice(listed, 1, limit) if limit else listed).alias("keys"))


@F.udf(T.StringType(), useArrow=True)
def _deep_document(text: str | None) -> str | None:
    """A document deeper than variants go, with sorted keys and no spaces; null where the text is no JSON container."""
    root = None if text is None else _parsed(text)
    return None if root is None else _sound(_text_of(root, sort_keys=True))


def payload_hash(text: Column | str) -> Column:
    """SHA-256 of the document with sorted keys (variants store members in key order), written without
    spaces; a text that is no JSON is hashed as it is, so malformed payloads stay apart.

    Documents that no variant holds, those nested too deep, are written by the payload reader; no others are sent to it.
    """
    text = F.col(text) if isinstance(text, str) else text
    shallow = F.to_json(F.try_parse_json(text))
    deep = _deep_document(F.when(shallow.isNull() & F.rlike(text, F.lit(r"^[ \t\n\r]*[{\[]")), text))
    return F.sha2(F.coalesce(shallow, deep, text), 256)
