import numpy as np
import pyarrow as pa
from ledgermint.llm import langid, quality
from ledgermint.llm.common import utf8
from ledgermint.llm.registry import queries

SF = "/root/testdata/sf0.01"


def test_byte_pair_tables_equal_the_network():
    net = langid.ByteConvNet(3)
    data, offsets = utf8(pa.array(["some Text, é" * 40, "x"]))
    cells, _, _ = langid.windows(data, offsets)
    p = net.params
    embedded = p["embed"][cells].reshape(len(cells), -1)
    hidden = np.concatenate([(np.lib.stride_tricks.sliding_window_view(embedded, 2 * w * langid.EMBED, axis=1)[:, :: 2 * langid.EMBED] @ p[f"conv{w}"]).max(axis=1) + p[f"bias{w}"] for w in langid.WIDTHS], axis=1)
    assert np.allclose(net.predict(cells, net.tables()), langid.softmax(np.maximum(hidden, 0) @ p["out"] + p["out_bias"]), atol=1e-4)


def test_gradient():
    net = langid.ByteConvNet(3, seed=9)
    r = np.random.default_rng(1)
    cells, labels = r.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    _, grad = net.loss_gradient(cells, labels)
    for k in ("conv2", "out", "bias1"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        before, step = net.params[k][at], 1e-5
        net.params[k][at] = before + step
        up = net.loss_gradient(cells, labels)[0]
        net.params[k][at] = before - step
        down = net.loss_gradient(cells, labels)[0]
        net.params[k][at] = before
        assert abs((up - down) / (2 * step) - grad[k][at]) < 1e-4


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries()["op3_language_id"](spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(spark, tmp_path):
    rows = [(1, None, "en", 1), (2, "123 !!", "en", 1), (3, "", None, 1), (4, "the house and the garden " * 9000, "en", 1), (5, "日本語", None, 1), (6, "der und das", "de", 1), (6, "der und das", "de", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op3_language_id"](spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3} and got[4].lang_pred in ("en", "de")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries()["op3_language_id"](spark, f"{tmp_path}/e").count() == 0


def test_machine_equals_all_pairs():
    m = quality.FactorisationMachine(50, 4)
    r = np.random.default_rng(2)
    m.w = r.normal(size=50).astype(np.float32)
    row, column, value = np.array([0, 0, 0, 1, 1]), np.array([3, 7, 9, 3, 20]), np.array([0.5, 1, 2, 1, 1.5], np.float32)
    want = []
    for k in (0, 1):
        c, x = column[row == k], value[row == k]
        z = sum(m.w[c] * x) + sum(m.v[c[i]] @ m.v[c[j]] * x[i] * x[j] for i in range(len(c)) for j in range(i))
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(m.score(row, column, value, 2), want, atol=1e-5)


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries()["op5_quality"](spark, SF).collect()
    good = [r.score for r in got if r.held_out and labels.get(r.doc_id) == 1]
    bad = [r.score for r in got if r.held_out and labels.get(r.doc_id) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean([s >= 0.3 for s in good]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_edge_rows(spark, tmp_path):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "word " * 60000, 1.0), (4, "a b", 1.0), (4, "a b", 1.0)]
    spark.createDataFrame(rows, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.score for r in queries()["op5_quality"](spark, str(tmp_path)).collect()] == [0.5] * 5
