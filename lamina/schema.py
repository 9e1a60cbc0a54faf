"""Schemas of the relations that an archive is seen as."""

from __future__ import annotations

PATH = "array<struct<kind:string,key:string,idx:int>>"
ARCHIVE_INFO = "archive string, version int, encrypted boolean, tensor_bytes bigint, tensor_count bigint"
CATALOG = (
    f"archive string, ordinal int, name string, path_json string, path {PATH}, tensor_type tinyint, numpy_dtype string, torch_dtype string, "
    "is_opaque boolean, shape array<bigint>, numel bigint, itemsize int, header_offset bigint, data_offset bigint, data_length bigint, "
    "deserialized_length bigint, is_meta boolean"
)
CRYPT = "struct<kdf:struct<opslimit:bigint,memlimit:bigint,alg:int,salt:binary>,scheme:string,chunk_size:bigint,nonce:binary,macs:array<binary>>"
HEADERS = f"{CATALOG}, module_idx int, header_size bigint, crc32 bigint, sha256 string, header_zeroed binary, crypt {CRYPT}"
CHUNKS = "archive string, ordinal int, name string, chunk_idx int, chunk_offset bigint, data binary"
ELEMENTS = "archive string, ordinal int, name string, flat_index bigint, coord array<bigint>, value double"
#: What a task read: the ordinals of its range, payload bytes and the seconds they took, and the server's cache status.
READS = "archive string, first int, last int, arrays int, bytes bigint, seconds double, cache_status string"
#: What the writer takes: whole arrays, one to a row.
ARRAYS = "name string, path_json string, tensor_type int, module_idx int, numpy_dtype string, torch_dtype string, shape array<bigint>, data binary"
RELATIONS = {"archive_info": ARCHIVE_INFO, "catalog": CATALOG, "headers": HEADERS, "chunks": CHUNKS, "reads": READS, "elements": ELEMENTS}
