"""Schemas of the decoded tables."""

from __future__ import annotations

import pyarrow as pa

TAG = "array<struct<key:string,value:string>>"
RAW_TAG = "array<struct<key_sid:bigint,value_sid:bigint>>"
INFO = "struct<version:int,timestamp_ms:bigint,changeset:bigint,uid:int,user:string,user_error:string,visible:boolean>"
LOCATION = "array<struct<nano_lat:bigint,nano_lon:bigint>>"
MEMBER = "array<struct<member_type:string,member_id:bigint,role:string,role_sid:int,role_error:string>>"

ELEMENTS = {
    "path": "string", "blob_offset": "bigint", "group_idx": "int", "elem_idx": "int", "kind": "string", "is_dense": "boolean", "id": "bigint",
    "nano_lat": "bigint", "nano_lon": "bigint", "tags": TAG, "raw_tags": RAW_TAG, "info": INFO, "refs": "array<bigint>", "raw_refs": "array<bigint>",
    "node_locations": LOCATION, "members": MEMBER,
}
BLOBS = {"path": "string", "blob_seq": "int", "blob_offset": "bigint", "blob_type": "string", "header_size": "int", "datasize": "int"}
HEADER = {
    "path": "string", "blob_offset": "bigint", "bbox": "struct<left:double,right:double,top:double,bottom:double>", "required_features": "array<string>",
    "optional_features": "array<string>", "writing_program": "string", "source": "string", "replication_timestamp": "bigint",
    "replication_sequence_number": "bigint", "replication_base_url": "string",
}
ZONES = {"path": "string", "blob_offset": "bigint", "kind": "string", "min_id": "bigint", "max_id": "bigint", "n": "bigint"}
STRINGS = {"path": "string", "blob_offset": "bigint", "strings": "array<binary>"}

KINDS = ("node", "way", "relation")

P_TAG = pa.struct([("key", pa.string()), ("value", pa.string())])
P_RAW = pa.struct([("key_sid", pa.int64()), ("value_sid", pa.int64())])
P_INFO = pa.struct([("version", pa.int32()), ("timestamp_ms", pa.int64()), ("changeset", pa.int64()), ("uid", pa.int32()), ("user", pa.string()), ("user_error", pa.string()), ("visible", pa.bool_())])
P_LOC = pa.struct([("nano_lat", pa.int64()), ("nano_lon", pa.int64())])
P_MEMBER = pa.struct([("member_type", pa.string()), ("member_id", pa.int64()), ("role", pa.string()), ("role_sid", pa.int32()), ("role_error", pa.string())])
ARROW = {
    "path": pa.string(), "blob_offset": pa.int64(), "group_idx": pa.int32(), "elem_idx": pa.int32(), "kind": pa.string(), "is_dense": pa.bool_(), "id": pa.int64(),
    "nano_lat": pa.int64(), "nano_lon": pa.int64(), "tags": pa.list_(P_TAG), "raw_tags": pa.list_(P_RAW), "info": P_INFO, "refs": pa.list_(pa.int64()), "raw_refs": pa.list_(pa.int64()),
    "node_locations": pa.list_(P_LOC), "members": pa.list_(P_MEMBER),
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())
