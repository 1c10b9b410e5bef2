"""The pipeline, stage by stage and as a whole, against plain versions."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from gridway.llm import common, mixing
from gridway.llm import quality as classifier

WORDS = "the of and river stone winter garden letter music table window street paper summer market bridge doctor silver orange yellow".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [sentence(rng.randrange(6, 120)) for _ in range(150)]
    texts += [texts[k] for k in (3, 3, 9, 20)] + [texts[k] + " end" for k in (30, 31, 32)] + ["$$ @@ ## 77 " * 30, None, " \n", sentence(2600)]
    return [(i, t, "en" if i % 9 else None, ["b", "a", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def test_pipeline_equals_plain_stages(spark, rows, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 120), int(i % 40 == 7)) for i in range(140)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    ids = spark.range(len(rows)).withColumnRenamed("id", "doc_id")
    calibrating = {r.doc_id for r in ids.filter(classifier.calibrates()).collect()}
    text = {i: t for i, t, *_ in rows}
    kept = brute.quality([r[:3] for r in rows], {i for i, q, x in labels if q and not x}, calibrating)
    assert 0 < len(set(text) - kept) < 20
    stages = [kept]
    largest = {}
    for i in sorted(kept):
        largest[text[i]] = i
    stages.append(set(largest.values()))
    label = brute.near_components({i: text[i] for i in stages[-1]})
    stages.append({i for i in label if label[i] == i})
    assert len(stages[0]) > len(stages[1]) > len(stages[2])

    by_source = defaultdict(list)
    names = spark.createDataFrame([(i, text[i], rows[i][3]) for i in stages[-1]], "doc_id bigint, text string, source string").withColumn("hash", F.xxhash64("text"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    named = names.withColumn("part", common.salt(mixing.PARTS, *("doc_id", "hash"), F.lit(1))).withColumn("offsets", F.array(*(mixing.offset_of(key, 7, k) for k in range(mixing.OFFSETS))))
    offsets = {}
    for r in named.collect():
        by_source[r.source].append((len(r.text.split()), (r.part, len(r.text.split()), r.doc_id), r.doc_id))
        offsets[r.source] = r.offsets
    goals = brute.targets({s: sum(x[0] for x in own) for s, own in by_source.items()})
    copies = Counter()
    for s, own in by_source.items():
        tried = [brute.systematic(own, goals[s], o) for o in offsets[s]]
        size = {i: n for n, _, i in own}
        copies.update(min(tried, key=lambda t: abs(sum(size[i] * n for i, n in Counter(t).items()) - goals[s])))
    stages.append(+copies)

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert Counter(r.doc_id for r in docs.collect()) == Counter(stages[k]), name

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = brute.pieces([(i, text[i]) for i in copies.elements()], lambda t: tok.encode(t, add_special_tokens=False).ids, 2048)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == Counter(wanted)
    assert len({r.sequence_id for r in found}) == brute.best_fit([w[3] for w in wanted], 2048)
