"""Queries without SQL, from their tables to their rows, against plain versions by other libraries."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import langid, matroska
from framewright.llm.queries import QUERIES


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_op5_digests(spark, sf):
    want = {}
    for r in documents(spark, sf):
        raw = (r.text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[r.doc_id] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        x = np.frombuffer(padded, dtype=np.uint8).astype(int) - 128
        want[r.doc_id] += (f"packets={len(padded) // 576};mean={x.sum() * 1000 // len(x)};",)
    got = QUERIES["op5_matroska"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id][:4] and r.feature.startswith(want[r.doc_id][4])
    files = {r.doc_id: r for r in matroska.encode_media(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in got:
        media = bytes(files[r.doc_id].media)
        assert (len(media), hashlib.sha256(media).hexdigest()) == (r.media_bytes, r.media_sha256)


def test_op5_cues_lead_to_packets(spark, sf):
    """Each cue's cluster begins with the cluster's id and its time; seeking finds the packet that a scan of all finds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") > 100).limit(40).select("doc_id", F.repeat("text", 40).alias("text"))
    files = matroska.encode_media(docs)
    media = {r.doc_id: bytes(r.media) for r in files.collect()}
    cues = matroska.cue_table(files)
    rows = cues.collect()
    assert len(rows) > len(media) and {r.doc_id for r in rows} == media.keys()
    for r in rows:
        assert media[r.doc_id][r.cluster : r.cluster + 4] == matroska.CLUSTER.to_bytes(4, "big")
    times = [(i, t) for i in media for t in (-5, 0, 71, 72, 10_000, 18_432, 10**9)] + [(next(iter(media)), 72)]
    packets = matroska.packet_table(matroska.decode_media(files))
    by = defaultdict(list)
    for p in packets.collect():
        by[p.doc_id].append(p)
    got = matroska.sought(spark.createDataFrame(times, "doc_id long, time long"), cues, packets).collect()
    assert sorted((r.doc_id, r.time) for r in got) == sorted(times)
    for r in got:
        later = sorted((p.timestamp, p.packet) for p in by[r.doc_id] if p.timestamp >= r.time)
        assert (r.timestamp, r.packet) == (later[0] if later else (None, None))
        before = [c.cluster for c in rows if c.doc_id == r.doc_id and c.time <= r.time]
        assert r.cluster == (max(before) if before else None)


def test_op3_pieces(spark, sf):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(path("word_bpe_49k.json")))
    want = {}
    for r in documents(spark, sf):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[r.doc_id, k] = (a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    got = QUERIES["op3_best_fit_packing"](spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= math.ceil(sum(r.length for r in got) / 4096) + 1


def plain_ppm(texts, order):
    """Counts of bytes by the contexts before them."""
    counts = defaultdict(Counter)
    for t in texts:
        raw = t.encode()
        for i in range(len(raw)):
            for k in range(min(order, i) + 1):
                counts[raw[i - k : i]][raw[i]] += 1
    return counts


def test_op2_predictions(spark, sf):
    """A plain coder, without the exclusion of bytes that a longer context has, which hardly changes which language is shortest."""
    rows = documents(spark, sf)
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, sf).collect()}
    assert got.keys() == {r.doc_id for r in rows} and all(0 <= r.score <= 1 for r in got.values())
    assert {i: r.held_out for i, r in got.items()} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    trees = {}
    for lang in {r.lang for r in rows if r.lang}:
        trees[lang] = plain_ppm([r.text for r in rows if r.lang == lang and not got[r.doc_id].held_out and r.text], langid.ORDER)

    def bits(raw, counts):
        total = 0.0
        for i in range(len(raw)):
            scale, done = 1.0, False
            for k in range(min(langid.ORDER, i), -1, -1):
                seen = counts.get(raw[i - k : i])
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if raw[i] in seen:
                    total -= math.log2(scale * seen[raw[i]] / (n + q))
                    done = True
                    break
                scale *= q / (n + q)
            if not done:
                total -= math.log2(scale / 256)
        return total

    agreed = checked = 0
    for r in rows:
        if not r.text or len(r.text) > 600 or not any(c.isalpha() for c in r.text):
            continue
        checked += 1
        best = min(trees, key=lambda lang: bits(r.text.encode(), trees[lang]))
        agreed += best == got[r.doc_id].lang_pred
    assert checked >= 20 and agreed >= 0.95 * checked
