import numpy as np
import pytest

from tallyband.llm import byte_gru
from tests.llm.helpers import AWKWARD, docs


def small(rng, k=3, c=2):
    parts = [rng.normal(0, 0.5, s) for s in [(256, 3 * k), (k, 3 * k), (256, 3 * k), (k, 3 * k), (2 * k, c), (c,)]]
    return parts, lambda: byte_gru.Network(("a", "b"), byte_gru.Direction(*parts[:2]), byte_gru.Direction(*parts[2:4]), *parts[4:])


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    parts, net = small(rng)
    data, labels = rng.integers(97, 100, (7, 5)), rng.integers(0, 2, 5)
    _, grads = byte_gru.gradients(net(), data, labels)
    for part, grad in zip(parts, grads, strict=True):
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) if n != 256 else int(rng.integers(97, 100)) for n in part.shape)
            keep = part[at]
            part[at] = keep + 1e-5
            up = byte_gru.gradients(net(), data, labels)[0]
            part[at] = keep - 1e-5
            down = byte_gru.gradients(net(), data, labels)[0]
            part[at] = keep
            assert grad[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_pooling_reads_every_byte():
    rng = np.random.default_rng(2)
    net = small(rng)[1]()
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 127, 128, 129, 1000, 3, 40_000)]
    got = byte_gru.pooled(net, texts)
    for text, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        for first in range(0, len(text), byte_gru.WINDOW):
            x = np.frombuffer(text[first : first + byte_gru.WINDOW], np.uint8).astype(np.int64)[:, None]
            both = np.concatenate([byte_gru._read(net.ahead, x)[0], byte_gru._read(net.back, x[::-1])[0][::-1]], axis=2)
            e = np.exp(both @ net.out + net.bias)
            total += (e / e.sum(axis=2, keepdims=True)).sum(axis=(0, 1))
        assert p == pytest.approx(total / len(text), abs=1e-4)


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = byte_gru.identified(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_awkward_rows(spark):
    got = byte_gru.identified(docs(spark)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5}
    assert byte_gru.identified(docs(spark, [])).count() == 0
    none = docs(spark, [(1, "some text", None, None, None, None, None, None, None)])
    assert [r.lang_pred for r in byte_gru.identified(none).collect()] == ["und"]
    net = byte_gru.fit(docs(spark))
    runs = byte_gru.labelled_runs(docs(spark), net).filter("doc_id = 7").orderBy("start").collect()
    assert runs[0].start == 0 and runs[-1].stop == 50_000


def test_rare_languages_are_in_the_sample(spark):
    rows = [(k, f"some words of number {k}", "en" if k % 400 else "eo", "s", 1, None, None, None, None) for k in range(1, 8001)]
    found = byte_gru.training_windows(docs(spark, rows), most=100)
    assert sum(lang == "eo" for lang, _ in found) >= 10 and len(found) < 2 * 400
