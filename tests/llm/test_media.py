import hashlib
import zlib

import numpy as np
from llmfixtures import ODD

from wavelark.llm import media


def test_rows_round_trip(make_docs):
    docs = make_docs([*ODD, "x" * 576, "y" * 577])
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for i, t in enumerate([*ODD, "x" * 576, "y" * 577]):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        stored = media.store(pad)
        assert media.read_back(stored) == pad and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert len(r.fp_time) == len(r.fp_hash) == int(r.feature.split(":")[0])
    assert got[3].feature == got[4].feature and len(got[7].fp_time) > 100
    assert media.media_columns(docs.limit(0)).count() == 0


def test_tones_are_found_where_they_are():
    t = np.arange(576 * 8)
    x = (127.5 + 50 * np.sin(2 * np.pi * 40 * t / 576) + 50 * np.sin(2 * np.pi * 100 * t / 576)).astype(np.uint8)
    at, bins = media.peaks(x.tobytes())
    assert set(bins.tolist()) == {40, 100} and set(at.tolist()) == set(range(15))
    times, hashes = media.fingerprints(x.tobytes())
    pairs = {(h >> 15, h >> 6 & 511, h & 63) for h in hashes.tolist()}
    assert {p[:2] for p in pairs} <= {(40, 40), (40, 100), (100, 40), (100, 100)} and times.tolist() == sorted(times.tolist())


def test_blocks_of_frames_change_nothing(monkeypatch):
    payload = media.payload_of(ODD[7])[1]
    whole = media.fingerprints(payload)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprints(payload)))


def test_fingerprints_by_their_definition():
    """Every frame's transform by a plain sum, every bin and pair looked at in turn."""
    rng = np.random.default_rng(4)
    n, hop = media.BLOCK, media.HOP
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n // 2 + 1)) / n)
    for text in ("some words that are spoken again and again, " * 60, "".join(chr(97 + k) for k in rng.integers(0, 26, 3000)), "ab" * 700, "x" * 600):
        x = np.frombuffer(media.payload_of(text)[1], np.uint8)
        found = []
        for t in range((len(x) - n) // hop + 1):
            mag = np.abs(((x[t * hop : t * hop + n].astype(float) - 128) * np.hanning(n)) @ turn)
            mag[:4] = 0
            tops = [k for k in range(1, len(mag) - 1) if mag[k] > mag[k - 1] and mag[k] >= mag[k + 1] and mag[k] > 2 * mag.mean() and mag[k] > 1]
            found += sorted((t, k) for k in sorted(tops, key=lambda k: -mag[k])[: media.PEAKS])
        pairs = []
        for i, (t, f) in enumerate(found):
            after = [p for p in found if p[0] > t][: media.FAN_OUT]
            pairs += [(t, f << 15 | g << 6 | u - t) for u, g in after if u - t <= media.SPAN]
        times, hashes = media.fingerprints(x.tobytes())
        assert list(zip(times.tolist(), hashes.tolist())) == sorted(pairs)


def test_missing_ids_and_clashing_columns(make_docs):
    got = media.media_columns(make_docs([(None, "a"), (None, "a"), (3, None)]).withColumnRenamed("n", "feature")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == [(0, 1), (0, 1), (3, 0)] and len({r.payload_sha256 for r in got}) == 2
