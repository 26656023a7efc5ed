"""The whole pipeline against a plain restatement of its stages, document by document."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from kinetable.llm import bpe, line_dedup, toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def without_recurring_lines(texts):
    con = duckdb.connect()
    con.execute("create table docs (doc_id bigint, text varchar)")
    con.executemany("insert into docs values (?, ?)", list(texts.items()))
    dropped = set(con.execute(f"WITH {line_dedup.ORACLE_DROP} SELECT d, line_no FROM dropped").fetchall())
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in dropped) for i, t in texts.items()}


def first_of_each_class(texts):
    bags = {}
    for i, t in texts.items():
        w = words(t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = bags[i], bags[j]
            small, large = sorted((a.total(), b.total()))
            if small >= 0.8 * large and (a == b or (a & b).total() >= 0.8 * (a | b).total()):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: t for i, t in texts.items() if top(i) == i}


def uncontaminated(texts, items):
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    kept = {}
    for i, t in texts.items():
        w, hit = words(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept[i] = t
    return kept


def test_pipeline_equals_its_stages(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    texts = {r.doc_id: r.text or "" for r in read("documents").collect()}
    scorer = toxicity.Scorer(toxicity.train(read("documents"), read("labels")))
    stages = [len(texts)]
    texts = {i: t for i, t in texts.items() if scorer([t])[0][0] < 0.5}
    stages.append(len(texts))
    before = dict(texts)
    texts = without_recurring_lines(texts)
    assert texts != before
    for step in (first_of_each_class, lambda t: uncontaminated(t, [r.text or "" for r in read("benchmark").collect()])):
        texts = step(texts)
        stages.append(len(texts))
    assert len(set(stages)) >= 3  # stages do something here
    tokenizer = Tokenizer.from_file(bpe.word_bpe_path())
    want = {}
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
