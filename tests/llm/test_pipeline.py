import hashlib
import random

import pytest

import __spark_entry__
import corpus_pipeline
from auditspark.llm.common import store
from auditspark.llm.secrets import MASK

from .test_toxicity import corpus


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    rows, known = corpus(5, 600)
    rnd = random.Random(6)
    labels = {d: t for d, _, t in known}
    clean = [d for d, t in labels.items() if not t]
    passage = " ".join("p%d" % rnd.randrange(1000) for _ in range(60))
    texts = dict(rows)
    for d in clean[:20]:  # a passage that many share
        texts[d] += " " + passage
    near = {}
    for k, d in enumerate(clean[20:50]):  # copies, exact and near
        words = texts[d].split()
        if k % 2 and len(words) > 60:
            words[-1] = "changed"
        near[1000 + k] = " ".join(words)
        if k % 2 and len(words) <= 60:
            near[1000 + k] = texts[d]
    secret = {d: hashlib.sha1(str(d).encode()).hexdigest() for d in clean[50:60]}
    for d, s in secret.items():
        texts[d] += f' token = "{s}" end'
    docs = [(d, t, "en", "s", len(t)) for d, t in {**texts, **near}.items()] + [(5000, None, None, None, None), (5001, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    df, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    out["start"] = df
    for name, stage in corpus_pipeline.STAGES:
        df = out[name] = store(stage(spark, df, path), name)
    return path, out, labels, near, passage, secret


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_stages(spark, staged):
    path, out, labels, near, passage, secret = staged
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "secret_scan", "packing"]
    columns = out["start"].columns
    for name in ("toxicity", "near_duplicates", "substring_dedup", "secret_scan"):
        assert out[name].columns == columns
    kept = set(ids(out["toxicity"]))
    toxic = [d for d, t in labels.items() if t]
    assert sum(d not in kept for d in toxic) / len(toxic) > 0.9
    assert sum(d in kept for d, t in labels.items() if not t) / (len(labels) - len(toxic)) > 0.98
    single = ids(out["near_duplicates"])
    assert len(single) == len(set(single)) and not set(single) & set(near) and {5000, 5001} <= set(single)
    assert kept - set(single) <= set(near)
    cut = {r["doc_id"]: r["text"] for r in out["substring_dedup"].collect()}
    assert sorted(cut) == sorted(single) and sum(passage in (t or "") for t in cut.values()) == 1
    masked = {r["doc_id"]: r for r in out["secret_scan"].collect()}
    for d, s in secret.items():
        if d in masked:
            assert s not in masked[d]["text"] and MASK in masked[d]["text"] and masked[d]["n_chars"] == len(masked[d]["text"])
    assert sorted(set(ids(out["packing"]))) == sorted(single)


def test_run_is_the_stages(spark, staged):
    path, out = staged[:2]
    found = corpus_pipeline.run(spark, path)
    key = lambda r: tuple(r)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(key, found.select(*columns).collect())) == sorted(map(key, out["packing"].select(*columns).collect()))


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def five_word_similarity(a, b):
    one, two = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(one & two) / len(one | two)


def test_near_copies_at_five_words(spark, docs):
    """Copies with one word changed: above and below 0.8 by length, all below 0.9 at three words."""
    rnd = random.Random(9)
    rows, pairs = [], []
    for k, n in enumerate([30, 40, 46, 48, 49, 50, 51, 52, 53, 54, 30, 50]):
        words = ["w%d" % rnd.randrange(10**6) for _ in range(n)]
        copy = [*words[: n // 2], "changed%d" % k, *words[n // 2 + 1 :]]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        pairs.append(five_word_similarity(rows[-2][1], rows[-1][1]))
    assert any(0.8 <= p < 0.9 for p in pairs) and any(p < 0.8 for p in pairs)
    wanted = sorted(2 * k + j for k, p in enumerate(pairs) for j in (0, 1) if not (j and p >= 0.8))
    assert sorted(ids(corpus_pipeline.one_of_each_group(spark, docs(rows), ""))) == wanted
