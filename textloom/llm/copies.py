"""Records that say the same in another format, collapsed to one.

A record is hashed from its leaves upwards: leaves are normalised to their
letters and digits, the digests of an unordered node's children are sorted, and
the root digest stands for the record. Records are grouped by root digest
together with the SHA-256 of their whole canonical form, so that a group is
confirmed by all of its text without the text being shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import WORD, letters_digits
from textloom.plans.materialize import Workspace

KEYS = ["tbl", "h1", "h2", "sha"]


def _leaf(value: object) -> str:
    if isinstance(value, bool):
        value = "true" if value else "false"
    return "".join(WORD.findall(str(value))).lower()


def merkle(value: object) -> tuple[bytes, str]:
    """The root digest and the canonical form, of values of any depth.

    Child digests are in order for arrays and sorted, after the digest of their
    name, for objects; the form has the children in the same order.
    """
    values, inner = [value], []
    for v in values:  # grows by the children, which therefore come after their parent
        if isinstance(v, _Object):
            inner.append((len(values), [_leaf(k) for k, _ in v.pairs]))
            values.extend(x for _, x in v.pairs)
        elif isinstance(v, list):
            inner.append((len(values), None))
            values.extend(v)
        else:
            inner.append(None)
    digests: list[bytes] = [b""] * len(values)
    order: list[list[int]] = [[]] * len(values)
    for i in range(len(values) - 1, -1, -1):
        v = values[i]
        if v is None:
            body = b"n"
        elif inner[i] is None:
            body = b"s" + _leaf(v).encode()
        elif inner[i][1] is None:
            order[i] = list(range(inner[i][0], inner[i][0] + len(v)))
            body = b"l" + b"".join(digests[k] for k in order[i])
        else:
            first, names = inner[i]
            marked = sorted((hashlib.blake2b(n.encode(), digest_size=16).digest() + digests[first + k], k) for k, n in enumerate(names))
            order[i] = [first + k for _, k in marked]
            body = b"o" + b"".join(m for m, _ in marked)
        digests[i] = hashlib.blake2b(body, digest_size=16).digest()
    form: list[str] = []
    todo: list[int | str] = [0]
    while todo:
        i = todo.pop()
        if isinstance(i, str):
            form.append(i)
        elif inner[i] is None:
            form.append("null" if values[i] is None else json.dumps(_leaf(values[i]), ensure_ascii=False))
        elif inner[i][1] is None:
            form.append("[")
            todo.append("]")
            for k in reversed(order[i]):
                todo += [",", k]
        else:
            form.append("{")
            todo.append("}")
            for k in reversed(order[i]):
                todo += [",", k, json.dumps(inner[i][1][k - inner[i][0]], ensure_ascii=False) + ":"]
    return digests[0], "".join(form)


class _Object:
    """A JSON object with all of its fields, equal names included."""

    def __init__(self, pairs: list[tuple[str, object]]) -> None:
        self.pairs = pairs


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def parse_deep(text: str) -> object:
    """JSON of any depth with a stack of its own; ValueError for anything else."""

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def name(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("a name is missing")
        key, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return key, skip(i + 1)

    stack: list[tuple[object, str | None]] = []
    i, key = skip(0), None
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            node: object = _Object([]) if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                value, i = node, i + 1
            else:
                stack.append((node, key))
                key = None
                if c == "{":
                    key, i = name(i)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif found := _NUMBER.match(text, i):
            value, i = found[0], found.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError("no value")
            value, i = _WORDS[word], i + len(word)
        while True:  # the value goes to the node around it, which may end with it
            i = skip(i)
            if not stack:
                if i != len(text):
                    raise ValueError("more than one value")
                return value
            node = stack[-1][0]
            node.pairs.append((key, value)) if isinstance(node, _Object) else node.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if isinstance(node, _Object):
                    key, i = name(i)
                break
            if c != ("}" if isinstance(node, _Object) else "]"):
                raise ValueError("an end is missing")
            value, key = stack.pop()
            i += 1


def parse_object(line: str | None) -> _Object | None:
    """The JSON object in a line, numbers kept as written; None for anything else."""
    if not line:
        return None
    line = line.lstrip("\ufeff")
    try:
        value = json.loads(line, object_pairs_hook=_Object, parse_int=str, parse_float=str, parse_constant=_refuse)
    except RecursionError:
        try:
            value = parse_deep(line)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if isinstance(value, _Object) else None


def keyed_texts(df: DataFrame, table: str, key: str, text: str) -> DataFrame:
    """``tbl, id, h1, h2, sha`` of a table of texts, each a single leaf; texts without a letter or digit are left out."""
    canon = letters_digits(F.col(text))
    out = df.select(F.lit(table).alias("tbl"), F.col(key).cast("bigint").alias("id"), canon.alias("canon"))
    out = out.where("id is not null and canon is not null and canon <> ''")
    return out.select("tbl", "id", F.xxhash64("canon").alias("h1"), F.xxhash64(F.lit(1), "canon").alias("h2"), F.unhex(F.sha2("canon", 256)).alias("sha"))


def keyed_objects(df: DataFrame, table: str, key: str, line: str) -> DataFrame:
    """``tbl, id, h1, h2, sha`` of a table of JSON lines of any depth; lines that hold no object are left out."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h1, h2, sha = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = parse_object(text)
                if value is None or i is None:
                    continue
                digest, form = merkle(value)
                ids.append(i)
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                sha.append(hashlib.sha256(form.encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([pa.array([table] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sha, pa.binary())], names=["tbl", "id", "h1", "h2", "sha"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(line).cast("string").alias("line"))
    return rows.mapInArrow(keyed, "tbl string, id bigint, h1 bigint, h2 bigint, sha binary")


def copy_sets(keyed: DataFrame) -> DataFrame:
    """``tbl, h1, h2, sha, keep_id, copies``: one row per set of equal records, single ones included.

    Counts are combined before the shuffle, so a set of a third of all rows
    crosses it as one row per task; a record crosses it as its digests.
    """
    return keyed.groupBy(*KEYS).agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def copies(keyed: DataFrame) -> DataFrame:
    """``tbl, keep_id, copy_id``: a row for every record but the first of its set.

    Null, blank and unparsable records are in no set. The digests of all rows
    are written once, so that texts are read and parsed once; rows of sets of
    several come back by a join, in which a hot set is one row on one side.
    """
    held = Workspace(keyed.sparkSession, "copies").cut(keyed)
    several = copy_sets(held).where("copies > 1").select(*KEYS, "keep_id")
    return held.join(several, KEYS).where("id > keep_id").select("tbl", "keep_id", F.col("id").alias("copy_id"))
