import math
import random

import numpy as np

from coclave.llm import language
from tests.llm import odd

SYLLABLES = {"aa": "ka to mi re su", "bb": "stra gren schul foll wund", "cc": "eau oi ion que ette"}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(n))


def test_held_out_and_mixtures(spark):
    rng = random.Random(1)
    train = [(k, text(rng, lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    model = language.fit(spark.createDataFrame([*train, (999, None, "aa"), (998, "ka to", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    held = [(k, text(rng, lang, rng.randint(3, 60)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in held) >= 88
    mixed = text(rng, "aa", 60) + " " + text(rng, "bb", 30)
    share = model.shares([mixed])[0]
    assert abs(share[0] - 2 / 3) < 0.1 and abs(share[1] - 1 / 3) < 0.1 and share[2] == 0
    assert model.shares([text(rng, "cc", 50)])[0].tolist() == [0, 0, 1]


def test_odd_rows(spark):
    docs = odd.documents(spark)
    model = language.fit(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == len(odd.rows()) and all(0 <= r["score"] <= 1 for r in got)
    und = sorted(str(r["doc_id"]) for r in got if r["lang_pred"] == "und")
    assert und == sorted(["4", "5", "6", "12", "None"])
    kept = language.keep_identified(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(got) - len(und)
    nothing = language.fit(odd.empty(spark))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(odd.empty(spark), model).count() == 0


def test_predictions_do_not_depend_on_neighbours(spark):
    model = language.fit(odd.documents(spark))
    alone = [model.predict([t])[1][0] for t in (odd.PROSE, odd.LONG[:5000], "größere")]
    together = model.predict([odd.PROSE, odd.LONG[:5000], "größere"])[1]
    assert max(abs(a - b) for a, b in zip(alone, together, strict=True)) < 1e-9


def test_shares_against_a_plain_estimation():
    """One text at a time, one word at a time: the same rounds of estimation, and languages that leave by the same rule."""
    rng = random.Random(7)
    model = language.Mixture(["aa", "bb", "cc"], np.log(np.random.default_rng(3).dirichlet(np.full(3, 0.3), language.CELLS)).astype(np.float32))

    def plain(said):
        words = said.split()
        likes = []
        for w in words:
            cells, _ = language.trigram_cells([w])
            ll = model.table[cells].sum(0, dtype=np.float64)
            likes.append(np.exp(np.maximum(ll - ll.max(), -80)))

        def rounds(share, n):
            for _ in range(n):
                parts = [x * share / max((x * share).sum(), 1e-300) for x in likes]
                share = np.sum(parts, 0) / len(words)
            return share, sum(math.log(max((x * share).sum(), 1e-300)) for x in likes)

        share, fit = rounds(np.full(3, 1 / 3), 6)
        active = [0, 1, 2]
        while len(active) > 1:
            least = min(active, key=lambda k: share[k])
            start = np.array([share[k] + 1e-9 if k in active and k != least else 0.0 for k in range(3)])
            trial, trial_fit = rounds(start / start.sum(), 3)
            if trial_fit + 0.5 * math.log(max(len(words), 2)) < fit:
                break
            share, fit = trial, trial_fit
            active.remove(least)
        return share / share.sum()

    for _ in range(60):
        said = " ".join(text(rng, rng.choice(list(SYLLABLES)), 1) for _ in range(rng.randint(1, 40)))
        assert np.allclose(model.shares([said])[0], plain(said), atol=1e-6), said
