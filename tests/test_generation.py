"""The generation loop against a sequential copy that works through one batch at a time."""

from collections import Counter, defaultdict
from dataclasses import replace

from corpusforge import testbed
from corpusforge.plans.generation import run_rounds
from corpusforge.operators.lengths import length_profile
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def judge(kind, seed, texts, ask):
    """Verdicts of the stand-in judge, or None (no JSON) or a short list (sentence forgotten)."""
    i, m = seed % 31, 9 if kind == "sv" else 7
    out = ["REJECT" if len(t) % m == 0 else "PASS" for t in texts]
    if i == 10:
        return None
    return out[:-1] if i == 20 or (i == 30 and ask == 1) else out


def verdicts(kind, rows):
    groups = defaultdict(list)
    for s in rows:
        groups[s["seed"]].append(s)
    for seed, group in groups.items():
        texts = [s["text"] for s in group]
        got = judge(kind, seed, texts, 1)
        if got is not None and len(got) != len(group):
            got = judge(kind, seed, texts, 2)
        for k, s in enumerate(group):
            ok = got is not None and len(got) == len(group)
            s[kind] = got[k] if ok else "VALIDATION_FAILED"
            s[f"{kind}_fb"] = (f"{kind} reason" if s[kind] == "REJECT" else None) if ok else "x"


def run_batch(batch_idx, seeds, std):
    out = {"accepted": [], "discarded": [], "retried": []}
    i = batch_idx % 7
    if i in (3, 5):
        return out
    plans = [(s, t) for s, t in sorted(seeds) for _ in range(5)]
    if batch_idx % 11 in (4, 8):
        return out
    now = []
    for p, (seed, text) in enumerate(plans):
        w = text.split(" ")
        now.append({"sid": p, "seed": seed, "plan": p, "rc": 0, "text": " ".join(w[:max(1, len(w) - p * 7 % 40)]) + f" {p}"})
    words, last = dict(seeds), len(plans) - 1
    for attempt in range(3):
        verdicts("sv", now)
        verdicts("lv", [s for s in now if s["sv"] == "PASS"])
        queue = []
        for s in now:
            lv = s.get("lv")
            if "VALIDATION_FAILED" in (s["sv"], lv):
                out["discarded"].append(s)
                continue
            bad = lv != "PASS" or abs(len(s["text"].split()) - len(words[s["seed"]].split())) > std
            if not bad:
                out["accepted"].append(s)
            elif s["rc"] >= 2:
                out["discarded"].append(s)
            else:
                queue.append(s)
        out["retried"] += queue
        if not queue:
            break
        now = []
        for k, s in enumerate(queue):
            now.append({"sid": last + 1 + k, "seed": s["seed"], "plan": s["plan"], "rc": s["rc"] + 1, "text": s["text"] + " again"})
        if batch_idx % 11 == 8:
            now = now[:-1]
        last += len(now)
    return out


def with_prompts(models):
    """Prompts made from the context of every kind of request, taken off again before the stand-ins; without them no answer parses."""
    of = lambda n: F.get_json_object("context", n)
    head = F.concat(of("$.language"), F.lit("|"), of("$.label"), F.lit("|"))
    batch = F.concat(head, F.size(F.from_json(of("$.seeds"), "array<struct<id bigint>>")).cast("string"), F.lit("|"))
    seed = F.concat(head, of("$.seed"), F.lit("|"))
    kinds = {"plan": batch, "write": batch, "retry": batch, "sentiment": seed, "language": seed}

    def checked(model, *allowed):
        def run(requests):
            payload = F.lit("no prompt")
            for k in allowed:
                start = F.concat(F.lit(f"{k}>"), kinds[k])
                payload = F.when(F.startswith(F.col("payload"), start), F.substr(F.col("payload"), F.length(start) + 1)).otherwise(payload)
            return model(requests.withColumn("payload", payload))
        return run

    prompts = {k: F.concat(F.lit(f"{k}>"), c) for k, c in kinds.items()}
    return replace(models, prompts=prompts, names={"en": "English"}, plan=checked(models.plan, "plan"), write=checked(models.write, "write", "retry"),
                   judge_sentiment=checked(models.judge_sentiment, "sentiment"), judge_language=checked(models.judge_language, "language"))


def test_loop_equals_sequential_copy(spark):
    seeds = testbed.seed_batches(spark, SF).cache()
    profile = length_profile(seeds, ["lang", "label"])
    got = run_rounds(seeds, with_prompts(testbed.loop_models()), profile)
    stds = {(r["lang"], r["label"]): (round(r["std"], 1) if r["std"] is not None else 14.0) for r in profile.collect()}
    batches = defaultdict(list)
    for r in seeds.collect():
        batches[(r["lang"], r["label"], r["batch_idx"])].append((r["id"], r["text"]))
    want, lost = {n: Counter() for n in ("accepted", "discarded", "retried")}, set()
    for key, rows in batches.items():
        res = run_batch(key[2], rows, stds[key[:2]])
        if not any(res.values()):
            lost.add(key)
        for n, sents in res.items():
            want[n].update((*key, s["sid"], s["seed"], s["plan"], s["rc"], s["text"]) for s in sents)
    for n in want:
        rows = got[n].select("lang", "label", "batch_idx", "sid", "seed_id", "plan_id", "retry_count", "text").collect()
        assert Counter(tuple(r) for r in rows) == want[n], n
    assert {(r["target_lang"], r["target_label"], r["batch_idx"]) for r in got["batch_failed"].collect()} == lost
