"""Features of text and JSON contents."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most characters, lines, list items and characters of a leaf in a flat text; levels of a schema; levels and list items that are searched for identifiers.
MOST_CHARS, MOST_LINES, MOST_ITEMS, MOST_LEAF, SCHEMA_LEVELS, SCAN_LEVELS, SCAN_ITEMS = 8000, 200, 10, 200, 5, 10, 100
#: Keys whose values identify something.
ID_KEYS = (
    "sku", "product_id", "productid", "item_id", "itemid", "upc", "ean", "gtin", "asin", "isbn",
    "order_id", "orderid", "booking_id", "bookingid", "trip_id", "tripid", "reservation_id", "reservationid", "transaction_id", "transactionid", "invoice_id", "invoiceid",
    "id", "uuid", "guid", "external_id", "externalid", "ref", "reference", "code",
)
#: The name that a schema gives to each kind of JSON value.
KINDS = {dict: "object", list: "array", str: "string", int: "integer", float: "number", bool: "boolean", type(None): "null"}


def decoded(content: Column | str) -> Column:
    """UTF-8, else Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))


def text_features(text: Column | str, most: int = MOST_CHARS) -> Column:
    """extracted_text, char_count, truncated. The excerpt is the feature; whole texts stay in their column."""
    t = F.col(text) if isinstance(text, str) else text
    return F.struct(F.substring(t, 1, most).alias("extracted_text"), F.length(t).alias("char_count"), (F.length(t) > most).alias("truncated"))


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def nodes(value, items: int | None = None, levels: int | None = None) -> Iterator[tuple[tuple, object, bool]]:
    """(path, node, more) of a JSON value and of all below it, in the order of the text.

    A path holds the keys and list positions from the top.  Lists go on for ``items`` items and
    values for ``levels`` levels, None for all; a list with more items comes once again after its
    last one, with ``more`` set.
    """
    waiting: list[tuple[tuple, object, bool]] = [((), value, False)]
    while waiting:
        path, node, more = waiting.pop()
        yield path, node, more
        if more or (levels is not None and len(path) >= levels) or not isinstance(node, (dict, list)):
            continue
        if isinstance(node, dict):
            waiting += [((*path, k), v, False) for k, v in reversed(node.items())]
            continue
        taken = node[:items]
        if len(taken) < len(node):
            waiting.append((path, node, True))
        waiting += [((*path, i), taken[i], False) for i in range(len(taken) - 1, -1, -1)]


def infer_schema(value, levels: int = SCHEMA_LEVELS) -> dict:
    """The type lattice of a JSON value; an array has the type of its first item."""
    made: dict[tuple, dict] = {}
    for path, node, more in nodes(value, 1, levels):
        if more:
            continue
        kind = "any" if len(path) >= levels else KINDS[type(node)]
        made[path] = {"type": kind} | {"object": {"properties": {}}, "array": {"items": {"type": "any"}}}.get(kind, {})
        if path and isinstance(path[-1], str):
            made[path[:-1]]["properties"][path[-1]] = made[path]
        elif path:
            made[path[:-1]]["items"] = made[path]
    return made[()]


def schema_hash(value) -> str:
    return hashlib.sha256(json.dumps(infer_schema(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def _at(path: tuple) -> str:
    return "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path).removeprefix(".")


def flatten(value, most_chars: int = MOST_CHARS) -> str:
    """``a.b[0]: leaf`` lines, and a note after each list that goes on."""
    lines: list[str] = []
    open_lists: set[tuple] = set()
    for path, node, more in nodes(value, MOST_ITEMS):
        if more and path in open_lists:
            lines.append(f"{_at(path)}: ... ({len(node)} items)")
        elif len(lines) >= MOST_LINES:  # only the notes of lists that began before are still due
            if not open_lists:
                break
        elif isinstance(node, list):
            if len(node) > MOST_ITEMS:
                open_lists.add(path)
        elif not isinstance(node, dict):
            leaf = "null" if node is None else str(node)
            lines.append(f"{_at(path)}: {leaf[:MOST_LEAF]}{'...' if len(leaf) > MOST_LEAF else ''}")
    return "\n".join(lines)[:most_chars]


def scan_ids(value, namespace: str = "json", levels: int | None = SCAN_LEVELS, items: int | None = SCAN_ITEMS) -> list[tuple[str, str, str]]:
    """(id_type, id_value, id_namespace) of the texts and whole numbers under the listed keys, each once.

    Nothing is searched below such a key.  ``levels`` and ``items`` (of each list) bound the
    search; None searches all.
    """
    named = lambda key: isinstance(key, str) and key.lower() in _ID_KEYS
    found = [(path[-1].lower(), str(node).strip(), namespace) for path, node, _ in nodes(value, items, levels) if path and named(path[-1]) and type(node) in (str, int) and not any(map(named, path[:-1]))]
    return [i for i in dict.fromkeys(found) if i[1]]


_ID_KEYS = frozenset(ID_KEYS)
_ID = T.StructType([T.StructField(n, T.StringType()) for n in ("id_type", "id_value", "id_namespace")])
JSON_FEATURES = T.StructType([
    T.StructField("valid", T.BooleanType()), T.StructField("is_array", T.BooleanType()), T.StructField("key_count", T.IntegerType()),
    T.StructField("schema_hash", T.StringType()), T.StructField("flat_text", T.StringType()), T.StructField("ids", T.ArrayType(_ID)),
])


@F.pandas_udf(JSON_FEATURES)
def json_features(texts: pd.Series) -> pd.DataFrame:
    """All features of a JSON text in one parse; texts that aren't JSON are not valid and have none."""
    rows = []
    for text in texts:
        value = _parsed(text)
        if value is None and (text is None or text.strip() != "null"):
            rows.append((False, None, None, None, None, []))
            continue
        first = value if isinstance(value, dict) else value[0] if isinstance(value, list) and value else None
        ids = [dict(zip(("id_type", "id_value", "id_namespace"), i)) for i in scan_ids(value)]
        rows.append((True, isinstance(value, list), len(first) if isinstance(first, dict) else None, schema_hash(value), flatten(value), ids))
    out = pd.DataFrame(rows, columns=["valid", "is_array", "key_count", "schema_hash", "flat_text", "ids"])
    out["key_count"] = out["key_count"].astype("Int32")
    return out


def extract_with(df: DataFrame, content: str, extractor: Callable[[pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """A user's extractor over a column of contents, a batch at a time; its fields come out as column ``extracted``."""
    return df.withColumn("extracted", F.pandas_udf(extractor, schema)(content))


def hashed_embedder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """An embedder that needs no model: words are hashed to signed places of a vector of length one; texts without words have none."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(word.encode())
                v[h % dim] += 1 if h >> 31 else -1
            length = np.linalg.norm(v)
            out.append((v / length).tolist() if length else None)
        return pd.Series(out, index=texts.index, dtype=object)

    return embed


def embed_with(df: DataFrame, text: str, embedder: Callable[[pd.Series], pd.Series] | None = None, batch: int = 32) -> DataFrame:
    """An embedder (texts to lists of numbers, in order) over a column, ``batch`` texts a call, as column ``embedding``.

    NULL texts aren't given to it and have no embedding.  Without an embedder, words are hashed.
    """
    call = embedder or hashed_embedder()

    def run(series: pd.Series) -> pd.Series:
        texts = series.dropna()
        parts = [call(texts.iloc[at : at + batch]) for at in range(0, len(texts), batch)]
        out = pd.Series([None] * len(series), index=series.index, dtype=object)
        for part in parts:
            out.loc[part.index] = part
        return out

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(text))


def merged_maps(base: Column, other: Column) -> Column:
    """The entries of two maps; those of ``other``, NULL values too, win. NULL maps are empty. No setting for repeated keys changes it."""
    held = lambda m: F.transform_values(F.coalesce(m, F.create_map()), lambda k, v: F.struct(v.alias("v")))
    return F.map_zip_with(held(base), held(other), lambda k, b, o: F.coalesce(o, b)["v"])


def merge_features(base: Column, other: Column) -> Column:
    """Two extraction results as one: ids of both, each once; other fields of ``other`` where it has them."""
    pick = lambda f: F.coalesce(other[f], base[f])
    ids = F.array_distinct(F.concat(F.coalesce(base["ids"], F.array()), F.coalesce(other["ids"], F.array())))
    return F.struct(pick("hash_value").alias("hash_value"), pick("extracted_text").alias("extracted_text"), ids.alias("ids"), merged_maps(base["extra"], other["extra"]).alias("extra"))
