import hashlib
import io
import tarfile
import zlib

import pyarrow.fs as fs

from scriptorium.llm import media
from scriptorium.llm.shared import fresh_path, written


def test_round_trip(spark, odd):
    rows = media.media_columns(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload)) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.encode(payload)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.feature == media.describe(payload)
    assert media.media_columns(odd.limit(0)).isEmpty()


def test_shards_are_tar_files_addressed_by_content(spark, documents):
    rows = documents("one", "two", "one", None, "").coalesce(1)
    manifest = written(media.store(rows, fresh_path(spark, "media"), shard_bytes=700), "manifest")
    places = manifest.collect()
    assert len({(p.shard, p.offset) for p in places}) == len({p.digest for p in places}) == 3
    for p in places:
        store, where = fs.FileSystem.from_uri(p.shard)
        with store.open_input_stream(where) as f:
            tar = tarfile.open(fileobj=io.BytesIO(f.read()))
        member = tar.getmember(f"{p.digest}.png")
        assert (member.offset_data, member.size) == (p.offset, p.length)
        assert hashlib.sha256(media.decode(tar.extractfile(member).read())).hexdigest() == p.digest
    heads = media.headers(manifest).collect()
    assert {(h.width, h.height, h.bits, h.format) for h in heads} == {(576, 1, 8, "png")}


def test_one_place_for_each_digest(spark, documents):
    """Tasks of their own store the same payloads: all rows of one name one place, whose header and bytes are read."""
    rows = documents("one", "two", "one", "one", "two", None, "").repartition(7)
    found = media.media_columns(rows, task_bytes=600).collect()
    assert len(found) == 7 and len({(r.shard, r.offset) for r in found}) == len({r.digest for r in found}) == 3
    assert {(r.width, r.height, r.bits, r.format) for r in found} == {(576, 1, 8, "png")}
    assert all(r.digest == r.payload_sha256 and r.length == r.media_bytes for r in found)


def test_headers_need_the_first_bytes_only():
    data = media.encode(b"\x01" * 1152)
    assert media.header(data[: media.HEADER_BYTES]) == (576, 2, 8, "png") and media.decode(data) == b"\x01" * 1152
