"""Deeply nested semi-structured records to related flat tables, by Merkle subtree identities.

``shred`` parses each payload once and hashes every object bottom-up over its canonical form (sorted
field names, scalars by type and value, children by their own hash). Two equal subtrees anywhere have
the same identity, so each is stored once in ``nodes``, while ``bridge`` keeps every parent-child
link with its field and ordinal and ``roots`` every occurrence of a whole record. A chunk that is
delivered again costs one row in ``roots``.

Any JSON shape goes in: fields may be missing, null, of another type, nested to any depth. The flat
tables of one kind of record are joins from the roots down the bridge; ``media_children`` is that for
Project VIC exports.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b
from json.encoder import encode_basestring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencase.functions.arrow import sliced
from lumencase.functions.payloads import whole_json
from lumencase.staging import cut

#: Flag fields and the names they have in results.
FLAGS = {
    "victimidentified": "victim_identified",
    "offenderidentified": "offender_identified",
    "isdistributed": "is_distributed",
    "issuspected": "is_suspected",
    "selfgenerated": "self_generated",
}
#: Between the fields of an object, and between a field's name and text, where its scalars are one text; JSON text never holds them.
SPLIT, NAMED = "\x1f", "\x1e"
#: Identities a task remembers to have given.
REMEMBERED = 1_000_000
#: Unicode white space as a class for regular expressions of the JVM.
_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def _scalar(value: Any) -> str:
    return encode_basestring(value) if isinstance(value, str) else json.dumps(value)


def _identity(kind: bytes, text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, person=kind).digest()


def _walk(value: Any, nodes: dict[bytes, tuple], links: list[tuple], seen: set[bytes]) -> bytes:
    """The identity of a value; adds what of it and below it is not ``seen`` to nodes and links.

    Values are numbered from the top, each before its children, and hashed in the reverse order, so no depth is too great.
    """
    values, below = [value], []
    for x in values:  # grows while it is read
        children: list[tuple[str, int, int]] = []
        if isinstance(x, dict):
            for field in sorted(x):
                y = x[field]
                if isinstance(y, dict):
                    children.append((field, -1, len(values)))
                    values.append(y)
                elif isinstance(y, list):
                    children += [(field, i, len(values) + i) for i in range(len(y))]
                    values += y
        elif isinstance(x, list):
            children = [("", i, len(values) + i) for i in range(len(x))]
            values += x
        below.append(children)
    ids: list[bytes] = [b""] * len(values)
    for n in range(len(values) - 1, -1, -1):
        x = values[n]
        if isinstance(x, dict):
            scalars = SPLIT.join(encode_basestring(f)[1:-1] + NAMED + ("{" if isinstance(x[f], dict) else "[" if isinstance(x[f], list) else _scalar(x[f])) for f in sorted(x))
            children = [(f, i, ids[m]) for f, i, m in below[n]]
            own = _identity(b"object", scalars + SPLIT + SPLIT + SPLIT.join(f"{encode_basestring(f)}{i}:{c.hex()}" for f, i, c in children))
            made = ("object", scalars, None)
        elif isinstance(x, list):
            children = [(f, i, ids[m]) for f, i, m in below[n]]
            own, made = _identity(b"array", "".join(c.hex() for _, _, c in children)), ("array", None, None)
        else:
            children, text = [], _scalar(x)
            own, made = _identity(b"scalar", text), ("scalar", None, text)
        ids[n] = own
        if own not in seen:
            seen.add(own)
            nodes[own] = made
            links += [(own, f, i, c) for f, i, c in children]
    return ids[0]


_SCHEMA = "part string, key string, node binary, field string, ordinal int, child binary, kind string, scalars string, value string"


def _clean(text: str | None) -> str | None:
    """Lone surrogates cannot be written as UTF-8; they become question marks."""
    return None if text is None else text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "key", "node", "field", "ordinal", "child", "kind", "scalars", "value"]
    types = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string()]
    seen: set[bytes] = set()
    for batch in sliced(batches):
        nodes: dict[bytes, tuple] = {}
        links: list[tuple] = []
        rows: list[tuple] = []
        if len(seen) > REMEMBERED:
            seen.clear()
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            value = whole_json(payload)
            if value is not None:
                rows.append(("root", key, _walk(value, nodes, links, seen), None, None, None, None, None, None))
        rows += [("node", None, n, None, None, None, k, _clean(s), _clean(v)) for n, (k, s, v) in nodes.items()]
        rows += [("link", None, n, _clean(f), i, c, None, None, None) for n, f, i, c in links]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def shred(records: DataFrame, key: str, payload: str) -> dict[str, DataFrame]:
    """roots (key, node), nodes (node, kind, scalars, value) and bridge (node, field, ordinal, child).

    ``scalars`` has each scalar field's JSON text, and '{' or '[' where a field holds an object or a
    list; control characters, quotes and backslashes in a field's name stand escaped there. ordinal is 0-based in a list and -1
    for an object that stands alone. A payload that is null, blank, damaged or nested beyond the JSON reader's
    depth gives nothing; rows with the same payload give one root each; other columns of ``records`` are ignored.
    """
    made = records.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("payload"))
    parts = cut(made.mapInArrow(_shred_batches, _SCHEMA), "part")
    nodes = parts.where("part = 'node'").groupBy("node").agg(F.first("kind").alias("kind"), F.first("scalars").alias("scalars"), F.first("value").alias("value"))
    nodes = nodes.withColumn("scalars", F.expr(f"if(kind = 'object', str_to_map(scalars, '{SPLIT}', '{NAMED}'), null)"))
    return {
        "roots": parts.where("part = 'root'").select("key", "node"),
        "nodes": nodes,
        "bridge": parts.where("part = 'link'").select("node", "field", "ordinal", "child").distinct(),
        "parts": parts,
    }


def _text(json_text: Column) -> Column:
    """A scalar's JSON text as the text it stands for: strings unquoted and trimmed, null and blank as null."""
    plain = F.when(json_text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")).otherwise(json_text)
    trimmed = F.regexp_replace(plain, f"^{_SPACE}+|{_SPACE}+$", "")
    return F.when((json_text != "null") & (trimmed != ""), trimmed)


def media(tables: dict[str, DataFrame]) -> DataFrame:
    """key, case_seq, media_seq, medium, scalars: one row per occurrence of a medium object."""
    roots, nodes, bridge = tables["roots"], tables["nodes"], tables["bridge"]
    objects = nodes.where("kind = 'object'").select("node", "scalars")
    place = F.greatest("ordinal", F.lit(0))
    value = F.col("scalars")["value"]
    tops = roots.join(objects, "node").select("key", "node", F.when(value.isNull() | (value == "null"), "Cases").otherwise("value").alias("field"))
    cases = tops.join(bridge.where("field in ('value', 'Cases')"), ["node", "field"]).select("key", F.col("child").alias("node"), place.alias("case_seq"))
    found = cases.join(bridge.where("field = 'Media'"), "node").select("key", "case_seq", place.alias("media_seq"), F.col("child").alias("node"))
    return found.join(objects, "node").select("key", "case_seq", "media_seq", F.col("node").alias("medium"), "scalars")


def _children_of_media(tables: dict[str, DataFrame]) -> DataFrame:
    """medium, child, child_seq, name: the children of each distinct medium, worked out once however often it occurs."""
    nodes, bridge = tables["nodes"], tables["bridge"]
    place = F.greatest("ordinal", F.lit(0))
    links = bridge.where("field in ('Exifs', 'Tags', 'Series')").select(F.col("node").alias("medium"), "field", place.alias("child_seq"), F.col("child").alias("node"))
    s = F.col("scalars")
    scalar = _text(F.col("value"))
    name = (
        F.when((F.col("field") == "Exifs") & (F.col("kind") == "object") & _text(s["PropertyValue"]).isNotNull(), _text(s["PropertyName"]))
        .when((F.col("field") == "Tags"), F.when(F.col("kind") == "object", _text(s["Tag"])).when(F.col("kind") == "scalar", scalar))
        .when((F.col("field") == "Series"), F.when(F.col("kind") == "object", _text(s["Name"])).when(F.col("kind") == "scalar", scalar))
    )
    child = F.element_at(F.create_map(F.lit("Exifs"), F.lit("exif"), F.lit("Tags"), F.lit("tag"), F.lit("Series"), F.lit("series")), F.col("field"))
    return links.join(nodes, "node").select("medium", child.alias("child"), "child_seq", name.alias("name")).where("name is not null")


def media_children(chunks: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """key, case_seq, media_seq, child, child_seq, name: one row per exif row, tag, series and true flag of a medium.

    Null, blank and shapeless children give no row but keep their place in the count. A value where a
    list is usual is a list of one; one string of tags is split at commas and semicolons.
    """
    tables = shred(chunks, key, payload)
    found = cut(media(tables))
    from_lists = found.select("key", "case_seq", "media_seq", "medium").join(_children_of_media(tables), "medium").select("key", "case_seq", "media_seq", "child", "child_seq", "name")
    # what stands in the medium itself: one string of tags or series, and the flags
    s = F.col("scalars")
    tags = F.transform(F.split(F.when(s["Tags"].startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), s["Tags"], F.lit("}")), "$.v")), "[,;]"), lambda x, i: F.struct(F.lit("tag").alias("child"), i.alias("child_seq"), F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "").alias("name")))
    one = lambda child, name: F.struct(F.lit(child).alias("child"), F.lit(0).alias("child_seq"), name.alias("name"))
    other_tag = F.when(~s["Tags"].startswith('"') & ~s["Tags"].isin("[", "{"), F.array(one("tag", _text(s["Tags"]))))
    series = F.when(~s["Series"].isin("[", "{"), F.array(one("series", _text(s["Series"]))))
    is_true = lambda t: F.lower(_text(t)).isin("true", "1") | (t == "1.0")
    names = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    flags = F.transform(
        F.array_distinct(F.transform(F.map_keys(F.map_filter(s, lambda f, t: F.lower(f).isin(*FLAGS) & is_true(t))), F.lower)),
        lambda f: F.struct(F.lit("flag").alias("child"), F.lit(0).alias("child_seq"), F.element_at(names, f).alias("name")),
    )
    empty = F.array().cast("array<struct<child:string,child_seq:int,name:string>>")
    own = F.concat(*[F.coalesce(x.cast("array<struct<child:string,child_seq:int,name:string>>"), empty) for x in (tags, other_tag, series, flags)])
    inline = found.select("key", "case_seq", "media_seq", F.explode(own).alias("c")).select("key", "case_seq", "media_seq", "c.*").where("name is not null and name != ''")
    return from_lists.unionByName(inline)


def vic_children(chunks: DataFrame) -> DataFrame:
    """``media_children`` of a table with raw_id BIGINT and payload, typed as the chunk table is."""
    return media_children(chunks).select(F.col("key").cast("long").alias("raw_id"), "case_seq", "media_seq", "child", "child_seq", "name")


def vic_media(chunks: DataFrame) -> DataFrame:
    """raw_id, case_seq, media_seq, media_identity, media_id, md5, mime: the flat table of media."""
    s = F.col("scalars")
    return media(shred(chunks, "raw_id", "payload")).select(
        F.col("key").cast("long").alias("raw_id"), "case_seq", "media_seq", F.lower(F.hex("medium")).alias("media_identity"),
        _text(s["MediaID"]).alias("media_id"), F.lower(_text(s["MD5"])).alias("md5"), _text(s["MimeType"]).alias("mime"),
    )


def sharing_report(chunks: DataFrame) -> DataFrame:
    """One row: chunks read, distinct_chunks, stored_values, links: what storing equal subtrees once saves."""
    tables = shred(chunks, "raw_id", "payload")
    roots = tables["roots"].agg(F.count("*").alias("chunks"), F.countDistinct("node").alias("distinct_chunks"))
    return roots.crossJoin(tables["nodes"].agg(F.count("*").alias("stored_values"))).crossJoin(tables["bridge"].agg(F.count("*").alias("links")))
