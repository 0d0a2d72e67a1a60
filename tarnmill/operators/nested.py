"""Deeply nested records to flat related tables with Merkle subtree identities.

Every object and array of a record is canonicalised (sorted keys, children replaced by their hash)
and hashed from the leaves up, so equal subtrees have equal hashes wherever they stand. Each
distinct subtree is stored once; each occurrence is a bridge row with its parent occurrence, field
and ordinal, so the records can be put together again exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import shuffle_partitions, spread, stage
from .skew import skew_join

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:(\.\d+)?([eE][-+]?\d+)?)", re.ASCII)
_MINUS_ZERO = tuple(f"{c}-0" for c in ":,[ \n\t\r")
_WORDS = {"true": True, "false": False, "null": None}


class Number(str):
    """A number as it was written, so that no digit is lost."""


def _no_constant(word: str):
    raise ValueError(f"{word} is no JSON")


_DECODER = json.JSONDecoder(parse_float=Number, parse_constant=_no_constant)
_EXACT = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def parse_json(text: str):
    """JSON of any depth. Raises ValueError if it is not valid (NaN is not). Of repeated keys of an
    object the last counts. Numbers keep their spelling."""
    try:
        return _EXACT.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _load(text: str):
    """As `parse_json`, faster: a whole number is an int where that is written like the number."""
    if not any(map(text.__contains__, _MINUS_ZERO)):
        try:
            return _DECODER.decode(text)
        except (ValueError, RecursionError):  # not valid, too deep, or more digits than an int is read from
            pass
    return parse_json(text)


def _parse_deep(text: str):
    """As `parse_json`, without recursion."""
    stack: list = []
    i, n = _SPACE.match(text, 0).end(), len(text)

    def value(i):
        c = text[i : i + 1]
        if c == '"':
            return scanstring(text, i + 1, True)
        m = _NUMBER.match(text, i)
        if m:
            return Number(m.group()), m.end()
        for w, v in _WORDS.items():
            if text.startswith(w, i):
                return v, i + len(w)
        raise ValueError(f"no value at {i}")

    def skip(i):
        return _SPACE.match(text, i).end()

    def key(i):
        if text[i : i + 1] != '"':
            raise ValueError(f"no key at {i}")
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return k, skip(i + 1)

    while True:
        c = text[i : i + 1]
        if c == "{":
            i = skip(i + 1)
            if text[i : i + 1] == "}":
                v, i = {}, i + 1
            else:
                k, i = key(i)
                stack.append(({}, k))
                continue
        elif c == "[":
            i = skip(i + 1)
            if text[i : i + 1] == "]":
                v, i = [], i + 1
            else:
                stack.append(([], None))
                continue
        else:
            v, i = value(i)
        while True:
            i = skip(i)
            if not stack:
                if i != n:
                    raise ValueError(f"more after the value at {i}")
                return v
            box, k = stack[-1]
            end = "}" if isinstance(box, dict) else "]"
            if isinstance(box, dict):
                box[k] = v
            else:
                box.append(v)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if end == "}":
                    k, i = key(i)
                    stack[-1] = (box, k)
                break
            if c != end:
                raise ValueError(f"no comma or {end} at {i}")
            stack.pop()
            v, i = box, i + 1


def parse_body(text: str | None):
    """The JSON value of a body; a string that holds JSON counts as that JSON. None if invalid."""
    try:
        v = _load(text) if text is not None else None
        while isinstance(v, str) and not isinstance(v, Number):
            v = _load(v)
        return v
    except ValueError:
        return None


def _utf8(s: str | None) -> str | None:
    """Halves of surrogate pairs, which a column can't hold, as question marks."""
    if s is None or s.isascii():
        return s
    return s.encode("utf-8", "replace").decode("utf-8")


_quote = json.encoder.encode_basestring


def _scalar(v) -> str:
    if isinstance(v, Number):
        return str(v)
    return _quote(v) if isinstance(v, str) else "null" if v is None else "true" if v is True else "false" if v is False else str(v)


class _Rows:
    """Columns of the rows of `merkle_rows`, filled body by body.

    The content and the fields of a subtree are given once for each batch; later occurrences of it
    have its hash only.
    """

    def __init__(self, anchor: str | None, fields: tuple[str, ...]):
        self.anchor, self.fields = anchor, fields
        self.quoted: dict[str, str] = {}
        self.start()

    def start(self) -> None:
        self.seen: set[str] = set()
        self.columns: list[list] = [[] for _ in range(10 + len(self.fields))]
        if len(self.quoted) > 100_000:
            self.quoted.clear()

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, key, root) -> None:
        if not isinstance(root, (dict, list)):
            return
        anchor, quoted, seen = self.anchor, self.quoted, self.seen
        keys, occs, parents, owners, kinds, pointers, names, ordinals, hashes, contents, *fields = self.columns
        base, order = len(keys), []
        stack: list = [(root, None, None, "", None, 0)]
        while stack:
            v, parent, owner, pointer, name, ordinal = stack.pop()
            occ = len(order)
            order.append(v)
            named = isinstance(v, dict)
            here = named and v.get(anchor) is not None
            keys.append(key)
            occs.append(occ)
            parents.append(parent)
            owners.append(owner)
            kinds.append("anchor" if here else "object" if named else "list")
            pointers.append(pointer)
            names.append(name)
            ordinals.append(ordinal)
            below = occ if here else owner
            at = len(v)
            for k in reversed(v) if named else range(at - 1, -1, -1):
                at -= 1
                x = v[k]
                kind = type(x)
                if kind is dict or kind is list:
                    if named:
                        step = k.replace("~", "~0").replace("/", "~1") if "~" in k or "/" in k else k
                        stack.append((x, occ, below, _utf8(f"{pointer}/{step}"), _utf8(k), at))
                    else:
                        stack.append((x, occ, below, f"{pointer}/{at}", None, at))
        n = len(order)
        hashes += [None] * n
        contents += [None] * n
        for f in fields:
            f += [None] * n
        refs: dict[int, str] = {}

        def text(x) -> str:
            kind = type(x)
            return _quote(x) if kind is str else refs[id(x)] if kind is dict or kind is list else _scalar(x)

        for at in range(n - 1, -1, -1):  # children come after their parent
            v = order[at]
            if type(v) is dict:
                parts = []
                for k in sorted(v):
                    q = quoted.get(k)
                    if q is None:
                        q = quoted[k] = _quote(k) + ":"
                    x = v[k]
                    kind = type(x)
                    parts.append(q + (_quote(x) if kind is str else refs[id(x)] if kind is dict or kind is list else _scalar(x)))
                content = "{" + ",".join(parts) + "}"
            else:
                content = "[" + ",".join(map(text, v)) + "]"
            h = hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            refs[id(v)] = f'{{"#":"{h}"}}'
            hashes[base + at] = h
            if h not in seen:
                seen.add(h)
                contents[base + at] = _utf8(content)
                if fields and type(v) is dict:
                    for f, name in zip(fields, self.fields):
                        x = v.get(name)
                        if x is not None:
                            f[base + at] = _utf8(x if type(x) is str else text(x))


def merkle_rows(root, anchor: str | None) -> list[tuple]:
    """(occ, parent_occ, owner, kind, pointer, field, ordinal, hash, content) of each object and array.

    occ numbers occurrences in document order; owner is the nearest enclosing object in which the
    field `anchor` has a value; kind is list, object, or anchor for an object in which it has one. content is
    canonical JSON in which a child is {"#": hash}; it is given where the subtree first comes up.
    """
    rows = _Rows(anchor, ())
    rows.add(None, root)
    return list(zip(*rows.columns[1:]))


_ROWS = "occ int, parent_occ int, owner int, kind string, pointer string, field string, ordinal int, hash string, content string"


def merkle_occurrences(df: DataFrame, key: str, body: str, anchor: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """One row for each object and array in each body: key, the columns of `merkle_rows`, and `f_` and
    name of each of `fields` with its value in the object: text as it is, all else as JSON.

    Content and fields are there at least once for each distinct subtree of a task, else null.
    Invalid, null, empty and scalar bodies give no rows. Equal keys are the caller's matter: their
    rows can't be told apart. Memory is that of one batch of rows and one body.
    """
    src = df.select(df[key].alias(key), df[body].alias("__body"))
    extra = [T.StructField(f"f_{f}", T.StringType()) for f in fields]
    schema = T.StructType([src.schema[key], *T._parse_datatype_string(_ROWS).fields, *extra])
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.string()] * len(fields)]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kind = _Rows(anchor, fields), pa.null()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.columns, [kind, *types])], names=names)
            rows.start()
            return out

        for b in batches:
            kind = b.column(0).type
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows.add(k, parse_body(text.as_py()))
                if len(rows) > 50_000:
                    yield batch()
        if len(rows):
            yield batch()

    return spread(src).mapInArrow(run, schema)


def merkle_tables(df: DataFrame, key: str, body: str, anchor: str | None = None, fields: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(objects, bridge): objects (hash, content, fields, uses) has each distinct subtree once; bridge
    (key, occ, parent_occ, owner, kind, pointer, field, ordinal, hash) each occurrence."""
    every = stage(merkle_occurrences(df, key, body, anchor, fields), "merkle")
    return distinct_objects(every, "content", *[f"f_{f}" for f in fields]), every.select(*every.columns[:9])


def distinct_objects(every: DataFrame, *columns: str) -> DataFrame:
    """(hash, columns, uses) of each distinct subtree, once: rows of several tasks are merged behind one
    shuffle on the hash, which a join on it uses again."""
    placed = every.select("hash", *columns).repartition(shuffle_partitions(every.sparkSession), "hash")
    return placed.groupBy("hash").agg(*[F.min(c).alias(c) for c in columns], F.count("*").alias("uses"))


def _entry() -> Column:
    """/process_trees and the entry of it that a pointer lies in."""
    return F.substring_index("pointer", "/", 3)


def process_nodes(reports: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """(key, tree_id, node_id, parent_id, name, ts, proc_path): each node of each tree under
    process_trees, from the objects and their occurrences.

    A node is an object with a node_id; its tree is the entry of process_trees it stands in (that
    entry's tree_id, else its key); its parent is its `parent` field, else the nearest node around
    it, else ''. A node that stands in a tree several times with one parent is one row. Fields are
    stored once for each distinct object; an occurrence carries its hash, and the commonest object
    is no hot key (`skew_join`).
    """
    fields = ("node_id", "parent", "name", "timestamp", "proc_path", "tree_id")
    every = stage(merkle_occurrences(reports, key, body, "node_id", fields), "merkle")
    values = [f"f_{f}" for f in fields]
    places = every.where(F.col("pointer").startswith("/process_trees/")).withColumns({"entry": _entry(), "is_entry": F.col("pointer") == _entry()})
    places = places.where((F.col("kind") == "anchor") | F.col("is_entry"))
    columns = [key, "occ", "owner", "kind", "entry", "is_entry", "field"]
    # An occurrence that has its content has its fields too; only later ones look them up.
    first = places.where("content is not null").select(*columns, *values)
    again = stage(places.where("content is null").select(*columns, "hash"), "repeated-objects")
    used = every.where("content is not null").join(again.select("hash").distinct(), "hash", "left_semi")
    looked_up = skew_join(again, distinct_objects(used, *values).drop("uses"), ["hash"]).drop("hash")
    known = stage(first.unionByName(looked_up), "report-nodes")
    nodes = known.where("kind = 'anchor'")
    trees = known.where("is_entry").select(key, "entry", F.coalesce("f_tree_id", "field", F.lit("")).alias("tree_id"))
    owners = nodes.select(key, F.col("occ").alias("owner"), F.col("f_node_id").alias("owner_id"))
    missing = lambda c: F.when(F.col(c).isin("None", "NaT", ""), F.lit(None)).otherwise(F.col(c))
    return (
        nodes.drop("occ", "field", "is_entry", "kind", "f_tree_id")
        .join(trees, [key, "entry"])
        .join(owners, [key, "owner"], "left")
        .groupBy(key, "tree_id", F.col("f_node_id").alias("node_id"), F.coalesce("f_parent", "owner_id", F.lit("")).alias("parent_id"))
        .agg(F.min("f_name").alias("name"), F.min(missing("f_timestamp")).alias("ts"), F.min("f_proc_path").alias("proc_path"))
    )


def report_hosts(reports: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """(key, host_id, host_name, op_sys, ip, env): one row for each body that is an object. An env
    that is itself an object gives its `stage`."""
    fields = ("host_id", "host_name", "op_sys", "ip", "env", "stage")
    objects, bridge = merkle_tables(reports, key, body, None, fields)
    at = bridge.where("kind = 'object' and pointer in ('', '/env')").select(key, "pointer", "hash")
    found = stage(skew_join(at, objects.drop("content", "uses"), ["hash"]), "report-hosts")
    env = found.where("pointer = '/env'").select(key, F.col("f_stage").alias("stage"), F.lit(True).alias("nested"))
    return found.where("pointer = ''").select(key, *[f"f_{f}" for f in fields[:-1]]).join(env, key, "left").select(
        key, *[F.col(f"f_{f}").alias(f) for f in fields[:-2]], F.when(F.col("nested"), F.col("stage")).otherwise(F.col("f_env")).alias("env")
    )


def report_iterations(reports: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """(key, tree_id, ordinal, start, elapsed, node_id): each [start, elapsed, node] of tree_iterations."""
    objects, bridge = merkle_tables(reports, key, body)
    of = bridge.where(F.col("pointer").startswith("/tree_iterations/") & (F.col("kind") == "list"))
    lists = of.select(key, F.col("occ").alias("parent_occ"), F.col("field").alias("tree_id")).where("tree_id is not null")
    rows = skew_join(of.where("field is null").select(key, "parent_occ", "ordinal", "hash"), objects, ["hash"])
    item = lambda i: F.get_json_object("content", f"$[{i}]")
    return rows.join(lists, [key, "parent_occ"]).select(
        key, "tree_id", "ordinal", item(0).alias("start"), F.expr("try_cast(get_json_object(content, '$[1]') as double)").alias("elapsed"), item(2).alias("node_id")
    )


def report_trees(reports: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """(key, tree_id, ordinal, hash): each entry of process_trees that is an object; equal trees have
    equal hashes."""
    objects, bridge = merkle_tables(reports, key, body, None, ("tree_id",))
    entries = bridge.where(F.col("pointer").startswith("/process_trees/") & (F.col("pointer") == _entry()) & (F.col("kind") != "list")).select(key, "ordinal", "field", "hash")
    return skew_join(entries, objects.select("hash", "f_tree_id"), ["hash"]).select(key, F.coalesce("f_tree_id", "field", F.lit("")).alias("tree_id"), "ordinal", "hash")


def _scalar_at(name: str, of: str = "content") -> Column:
    return F.get_json_object(of, f"$.{name}")


def _items(content: str) -> Column:
    """Hashes of the items of a list of objects; null for an item that is null."""
    return F.transform(F.from_json(content, "array<struct<`#`:string>>"), lambda x: x["#"])


def state_rows(objects: DataFrame, bridge: DataFrame, key: str = "state_id") -> DataFrame:
    """One row for each agent state, from the tables of `merkle_tables` over agent_states."""
    places = {"root": "", "host": "/host", "site": "/host/site", "disk": "/disk", "main": "/disk/main"}
    parts = bridge.where(F.col("pointer").isin(*places.values())).join(objects, "hash")
    of = parts.groupBy(key).agg(*[F.max(F.when(F.col("pointer") == p, F.col("content"))).alias(n) for n, p in places.items()])
    return of.select(
        key, _scalar_at("id", "host").alias("host_id"), F.coalesce(_scalar_at("os", "host"), _scalar_at("host_os", "root")).alias("host_os"), _scalar_at("room", "site").alias("host_site_room"),
        _scalar_at("rack", "site").cast("int").alias("host_site_rack"), F.coalesce(_scalar_at("mount", "main"), _scalar_at("disk_main_mount", "root")).alias("disk_main_mount"),
        _scalar_at("label", "main").alias("disk_main_label"), F.nanvl(_scalar_at("size_gb", "main").cast("double"), F.lit(None).cast("double")).alias("disk_main_size_gb"),
        _scalar_at("encrypted", "disk").cast("boolean").alias("disk_encrypted"),
    )


def state_nics(objects: DataFrame, bridge: DataFrame, key: str = "state_id") -> DataFrame:
    """(key, nic_ord, nic, mtu): each item of nics, one that is null too."""
    lists = bridge.where("pointer = '/nics'").join(objects, "hash")
    return lists.select(key, F.posexplode(_items("content")).alias("nic_ord", "hash")).join(objects, "hash", "left").select(
        key, "nic_ord", _scalar_at("nic").alias("nic"), _scalar_at("mtu").cast("int").alias("mtu")
    )


def state_addresses(objects: DataFrame, bridge: DataFrame, key: str = "state_id") -> DataFrame:
    """(key, nic_ord, addr_ord, ip, scopes): each item of each nic's addrs, one that is null too."""
    lists = bridge.where(F.col("pointer").rlike("^/nics/[0-9]+/addrs$")).join(objects, "hash")
    nic = F.split("pointer", "/")[2].cast("int").alias("nic_ord")
    items = lists.select(key, nic, F.posexplode(_items("content")).alias("addr_ord", "hash")).join(objects, "hash", "left")
    items = items.select(key, "nic_ord", "addr_ord", _scalar_at("ip").alias("ip"), F.get_json_object("content", "$.scopes.#").alias("hash"))
    return items.join(objects, "hash", "left").select(key, "nic_ord", "addr_ord", "ip", F.array_join(F.from_json("content", "array<string>"), ",").alias("scopes"))


def state_tags(objects: DataFrame, bridge: DataFrame, key: str = "state_id") -> DataFrame:
    """(key, tag_ord, tag): each item of host.site.tags, one that is null too."""
    lists = bridge.where("pointer = '/host/site/tags'").join(objects, "hash")
    return lists.select(key, F.posexplode(F.from_json("content", "array<string>")).alias("tag_ord", "tag"))


def state_marks(objects: DataFrame, bridge: DataFrame, key: str = "state_id") -> DataFrame:
    """(key, mark, value): each entry of the map marks."""
    maps = bridge.where("pointer = '/marks'").join(objects, "hash")
    return maps.select(key, F.explode(F.from_json("content", "map<string,string>")).alias("mark", "value"))


def flatten_json(df: DataFrame, key: str, body: str, sep: str = "->") -> DataFrame:
    """(key, path, value): each leaf of a JSON object under its keys joined by `sep`. A list is a leaf,
    given as JSON, and so is any scalar, given as text (null stays null); empty objects vanish.
    Bodies that are no JSON object give nothing."""
    src = df.select(df[key].alias(key), df[body].alias("__body"))
    schema = T.StructType([src.schema[key], *T._parse_datatype_string("path string, value string").fields])
    names = [f.name for f in schema.fields]

    def text(v):
        if isinstance(v, list):
            return canonical(v)
        return v if v is None or isinstance(v, str) else _scalar(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, paths, values = [], [], []
            for k, body_ in zip(b.column(0).to_pylist(), b.column(1)):
                v = parse_body(body_.as_py())
                stack = [((), v)] if isinstance(v, dict) else []
                while stack:
                    at, x = stack.pop()
                    if isinstance(x, dict):
                        stack += [((*at, name), y) for name, y in reversed(x.items())]
                    else:
                        keys.append(k)
                        paths.append(_utf8(sep.join(at)))
                        values.append(_utf8(text(x)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=names)

    return src.mapInArrow(run, schema)


def canonical(root) -> str:
    """Compact JSON with sorted keys of a parsed value."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):  # text that is written as it is
            out.append(v[0])
        elif isinstance(v, dict):
            parts: list = [("{",)]
            for i, k in enumerate(sorted(v)):
                parts += [(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":",), v[k]]
            stack += reversed([*parts, ("}",)])
        elif isinstance(v, list):
            parts = [("[",)]
            for i, x in enumerate(v):
                parts += [(",",), x] if i else [x]
            stack += reversed([*parts, ("]",)])
        else:
            out.append(_scalar(v))
    return "".join(out)
