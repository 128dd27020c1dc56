import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import audio


def tune(rng, notes=64):
    return rng.uniform(-0.5, 0.5, notes)


def direct(image, at, filters):
    out = 0
    for kind, p, h, w in filters:
        t = (audio.SPAN - w) // 2
        cut = lambda t0, t1, p0, p1: sum(image[at + i][q % 12] for i in range(t0, t1) for q in range(p0, p1))
        whole = cut(t, t + w, p, p + h)
        if kind == 0:
            a, b = cut(t, t + w, p, p + h // 2), cut(t, t + w, p + h // 2, p + h)
        elif kind == 1:
            a, b = cut(t, t + w // 2, p, p + h), cut(t + w // 2, t + w, p, p + h)
        elif kind == 2:
            a = cut(t, t + w // 2, p, p + h // 2) + cut(t + w // 2, t + w, p + h // 2, p + h)
            b = whole - a
        else:
            q = max(w // 4, 1)
            a = cut(t + q, t + w - q, p, p + h)
            b = whole - a
        v = np.log((1 + max(a, 0)) / (1 + max(b, 0)))
        out = out << 2 | (0, 1, 3, 2)[sum(v > s for s in audio._STEPS)]
    return out


def test_integral_image_equals_direct_sums():
    pcm = audio.render(tune(np.random.default_rng(1)))
    samples = np.frombuffer(pcm, dtype="<i2") / 32768.0
    image, fp = audio.chroma(samples), audio.fingerprint(pcm)
    assert len(fp) == len(image) - audio.SPAN + 1
    wrong = sum(bin(int(fp[i]) ^ direct(image, i, audio.FILTERS)).count("1") for i in range(0, len(fp), 7))
    assert wrong <= 2  # a value on a step may fall to either side


def test_pitch_classes():
    t = np.arange(8000) / audio.RATE
    for hz, pitch in ((440.0, 9), (261.63, 0), (880.0, 9)):
        assert set(np.argmax(audio.chroma(np.sin(2 * np.pi * hz * t)), axis=1)) == {pitch}


def test_robust_to_noise_and_gain():
    rng = np.random.default_rng(2)
    pcm = np.frombuffer(audio.render(tune(rng)), dtype="<i2").astype(float)
    noisy = (pcm * 0.4 + rng.normal(scale=200, size=len(pcm))).astype("<i2").tobytes()
    a, b = audio.fingerprint(pcm.astype("<i2").tobytes()), audio.fingerprint(noisy)
    other = audio.fingerprint(audio.render(tune(rng)))
    assert audio.errors(a, b, 0)[0] < 0.08 < 0.25 < audio.errors(a, other, 0)[0]


def test_alignment_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, tunes = [], []
    for i in range(60):
        tunes.append(tune(rng))
        rows.append((i, audio.render(tunes[-1])))
    for i in range(20):  # later starts, earlier ends and noise
        base = np.frombuffer(audio.render(tunes[i]), dtype="<i2").astype(float)
        cut = base[audio.HOP * (3 * i) :]
        rows.append((100 + i, (cut + rng.normal(scale=150, size=len(cut))).astype("<i2").tobytes()))
    rows += [(200, None), (201, b""), (202, bytes(100_000)), (203, b"\x01"), (300, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, media binary")
    prints = audio.fingerprints(df, "vec_id", "media")
    classes, links = audio.align(prints, "vec_id", F.col("vec_id") < 20)
    ids = {r["cid"]: r["class_id"] for r in classes.collect()}
    got = {(ids[r["one"]], ids[r["other"]]): r["offset"] for r in links.collect()}
    fps = {k: audio.fingerprint(m) for k, m in rows}
    want = set()
    for a in range(20):
        for b in sorted({*range(60), *range(100, 120)}):
            if a != b and len(fps[b]):
                for o in range(-len(fps[a]), len(fps[b])):
                    share, n = audio.errors(fps[a], fps[b], o)
                    if n >= audio.LEAST_OVERLAP * min(len(fps[a]), len(fps[b])) and share <= audio.MOST_ERRORS:
                        want.add((a, b))
    assert len(want) >= 20 and len(want & set(got)) / len(want) >= 0.9 and set(got) <= want
    assert all(got[i, 100 + i] == -3 * i for i in range(20) if (i, 100 + i) in got)
    assert len({v for v in ids.values()}) == len(ids) and sum(r["query"] for r in classes.collect()) == 20


def test_query_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [tune(rng).tolist() for _ in range(30)]
    near = [x + 0.001 for x in vectors[0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(50, vectors[3], 0), (100, near, 0), (101, None, 0), (102, [], 0), (103, [float("nan")] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = audio.op3_chroma_align(spark, str(tmp_path)).collect()
    by = {}
    for r in out:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == {r[0] for r in rows} and by[50][0]["class_id"] == 3 and by[102][0]["class_id"] == 101
    assert by[0][0]["queried"] and not by[1][0]["queried"]
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert audio.op3_chroma_align(spark, f"{tmp_path}/none").count() == 0


def block(*prints):
    return audio.Block.of([{"cid": i, "fp": p.tobytes()} for i, p in enumerate(prints)])


def test_pairs_near_the_error_limit_and_short_recordings():
    rng = np.random.default_rng(7)
    bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
    want = got = short = 0
    for n in (1, 2, 7, 24, 25, 40, 112):
        for _ in range(40):
            a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
            b = np.concatenate([rng.integers(0, 1 << 32, rng.integers(0, 4), dtype=np.uint32), a ^ ((rng.random((n, 32)) < 0.13) * bit).sum(1).astype(np.uint32)])
            tried = [(o, *audio.errors(a, b, o)) for o in range(-len(a), len(b))]
            good = {o: share for o, share, size in tried if size >= audio.LEAST_OVERLAP * min(len(a), len(b)) and share <= audio.MOST_ERRORS}
            found = {q: (o, share) for q, o, _, share in audio._matches(b, block(a, rng.integers(0, 1 << 32, 60, dtype=np.uint32)))}
            assert 0 not in found or abs(good[found[0][0]] - found[0][1]) < 1e-12
            assert n > audio.SHORT or (0 in found) == bool(good)  # short ones are exact
            want, got, short = want + bool(good), got + (0 in found), short + (bool(good) and n <= audio.SHORT)
    assert short > 60 and got >= 0.97 * want


def test_sustained_tones_and_chunks(monkeypatch):
    tone = np.full(200, 12345, dtype=np.uint32)
    assert audio._matches(tone, block(tone[:150], tone[:9])) == [(0, 0, 2, 0.0), (1, 0, 0, 0.0)]
    rng = np.random.default_rng(8)
    motif = np.tile(rng.integers(0, 1 << 32, 6, dtype=np.uint32), 40)
    some = block(motif[:90], motif[4:200], rng.integers(0, 1 << 32, 80, dtype=np.uint32))
    whole = audio._matches(motif, some)
    monkeypatch.setattr(audio, "CHUNK", 64)
    assert audio._matches(motif, some) == whole and [q for q, *_ in whole] == [0, 1]


def test_blocks_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    tunes = [tune(rng) for _ in range(12)]
    rows = [(i, bytearray(audio.render(t))) for i, t in enumerate(tunes)] + [(20 + i, bytearray(audio.render(t[8:]))) for i, t in enumerate(tunes)] + [(None, bytearray(audio.render(tunes[0][:50])))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "vec_id long, media binary"), "vec_id", "media")
    links = lambda: {tuple(r) for r in audio.align(prints, "vec_id", F.col("vec_id") < 12)[1].collect()}
    whole = links()
    monkeypatch.setattr(audio, "BLOCK_POSITIONS", 300)
    assert links() == whole and len(whole) >= 12
