"""The agent loop against plain Python: lists kept over rounds, each term searched once, runs reranked."""

import json
import re
from collections import Counter

from loomline.operators import retrieval
from loomline.plans import dataset, providers

WORDS = "red blue green stone river cloud paper glass iron wood".split()


def agent():
    """Made in a function, so that workers get it by value."""

    class Agent(providers.LocalProvider):
        """Asks for two words a round, coming back to earlier ones; its score of a text with ``iron`` is no number."""

        def act(self, row):
            words, step = row["query"].split(), int(row["step"])
            return "Sure: " + json.dumps({"search_calls": [words[step % len(words)], words[0], "nowhere"], "reasoning": ""}) if words else "none"

        def rerank(self, row):
            if "iron" in row["text"]:
                return "no score"
            return super().rerank(row)

    return Agent()


def test_three_rounds_equal_plain_python(spark, tmp_path):
    texts = [" ".join(WORDS[(i * j) % 10] for j in range(1, 3 + i % 5)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(q, " ".join(WORDS[(q + 3 * j) % 10] for j in range(3))) for q in range(8)] + [(8, "")]
    judged = {(q, (7 * q + 3) % 40) for q in range(9)}
    queries = spark.createDataFrame(asked, "query_id long, query string")
    qrels = spark.createDataFrame(sorted(judged), "query_id long, doc_id long")
    got = {(r["query_id"], r["step"]): (r["n_calls"], r["first_rank"], r["hit_20"]) for r in dataset.agent_loop(spark, docs, queries, qrels, agent(), most_steps=3, scratch=str(tmp_path)).collect()}

    terms = spark.createDataFrame([(w, w) for w in [*WORDS, "nowhere"]], "query_id string, term string")
    lists = {}
    for r in retrieval.bm25_lists(docs, terms, 100).collect():
        lists.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    expected, calls, asker = {}, [], agent()
    for q, query in asked:
        for step in range(3):
            reply = asker.act({"query": query, "step": step})
            found = json.loads(re.search(r"\{.*\}", reply).group())["search_calls"] if "{" in reply else []
            calls += found
            score, first = Counter(), {}
            for at, term in enumerate(found, 1):
                for rank, doc in lists.get(term, []):
                    score[doc] += 1 / (60 + rank)
                    first[doc] = min(first.get(doc, (at, rank)), (at, rank))
            run = sorted(score, key=lambda d: (-round(score[d], 9), first[d]))
            told = {d: 0.0 if "iron" in texts[d] else float(asker.rerank({"query": query, "text": texts[d]})) for d in run}
            run.sort(key=lambda d: -told[d])
            place = next((i for i, d in enumerate(run, 1) if (q, d) in judged), 0)
            expected[q, step] = (len(found), place, int(0 < place <= 20))
            if place == 1:
                break
    assert got == expected and {s for _, s in got} == {0, 1, 2}
    searched = [r["term"] for r in spark.read.parquet(f"{next(tmp_path.iterdir())}/terms").collect()]
    assert sorted(searched) == sorted(set(calls)) and len(calls) > 2 * len(searched)
