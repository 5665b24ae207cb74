"""Arrow arrays brought to a declared type, and files opened from tasks."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs

from colloquy.sources.storage import s3_options


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path on it; object-store settings from the environment."""
    scheme, mark, rest = uri.partition("://")
    if mark and scheme in ("s3", "s3a", "s3n"):
        options = s3_options()
        return fs.S3FileSystem(
            access_key=options.get("fs.s3a.access.key"),
            secret_key=options.get("fs.s3a.secret.key"),
            endpoint_override=options.get("fs.s3a.endpoint"),
            region=options.get("fs.s3a.endpoint.region"),
        ), rest
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if mark:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def exists(uri: str) -> bool:
    system, path = file_system(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def _without_nulls(value):
    """Plain data as JSON text shows it: null fields of objects are left out."""
    if isinstance(value, dict):
        return {name: _without_nulls(item) for name, item in value.items() if item is not None}
    if isinstance(value, (list, tuple)):
        return [_without_nulls(item) for item in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def _cast_values(values: pa.Array, want: pa.DataType) -> pa.Array:
    """A cast that makes null what has no value of the type."""
    try:
        return values.cast(want)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass
    out = []
    for value in values:
        try:
            out.append(value.cast(want).as_py())
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            out.append(None)
    return pa.array(out, want)


def conformed(values: pa.Array, want: pa.DataType) -> pa.Array:
    """Fields match by name, absent ones are null, nested values for text become JSON text.

    A value of another shape counts as missing, as ``conform`` has it.
    """
    have = values.type
    if have == want:
        return values
    listed = pa.types.is_list(have) or pa.types.is_large_list(have)
    if pa.types.is_string(want) and (listed or pa.types.is_struct(have) or pa.types.is_map(have)):
        texts = [
            None if value is None else json.dumps(_without_nulls(value), ensure_ascii=False, separators=(",", ":"))
            for value in values.to_pylist(maps_as_pydicts="lossy")
        ]
        return pa.array(texts, want)
    if pa.types.is_struct(want):
        if not pa.types.is_struct(have):
            return pa.nulls(len(values), want)
        places = {have.field(i).name: i for i in range(have.num_fields)}
        fields = [want.field(i) for i in range(want.num_fields)]
        arrays = [
            conformed(values.field(places[field.name]), field.type) if field.name in places else pa.nulls(len(values), field.type)
            for field in fields
        ]
        return pa.StructArray.from_arrays(arrays, fields=fields, mask=values.is_null())
    if pa.types.is_list(want):
        if not listed:
            return pa.nulls(len(values), want)
        lengths = pc.fill_null(pc.list_value_length(values), 0).cast(pa.int32())
        ends = pc.cumulative_sum(lengths)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        items = conformed(values.flatten(), want.value_type)
        return pa.ListArray.from_arrays(offsets, items, type=want, mask=values.is_null())
    return _cast_values(values, want)
