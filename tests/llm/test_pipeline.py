"""Every stage of the pipeline against a plain version of it, each on its own input."""

import hashlib

import corpus_pipeline as P
from homescore.llm import quality_model, secrets
from homescore.llm.common import stage, table
from tests.llm import test_near_dedup, test_substring_dedup, test_tokens

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_stages(spark):
    docs = stage(table(spark, SF, "documents"), "input")
    given, columns = rows(docs), docs.columns
    seen = []
    for name, step in P.STAGES:
        out = step(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out = stage(out, "out")
        seen.append(name)
        got = rows(out) if name != "packing" else out.collect()
        if name == "quality classifier":
            model = quality_model.fit_unheld(table(spark, SF, "documents"), table(spark, SF, "labels"))
            scores = dict(zip(given, quality_model.score_texts([r["text"] for r in given.values()], model)))
            assert got == {k: r for k, r in given.items() if scores[k] >= 0.7}
            assert 0 < len(got) < len(given)
        elif name == "near-dedup":
            _, links = test_near_dedup.all_pairs({k: r["text"] for k, r in given.items()})
            want = test_near_dedup.roots(given, links)
            assert got == {k: r for k, r in given.items() if want[k] == k}
        elif name == "substring dedup":
            want = test_substring_dedup.expected([r["text"] for r in given.values()], 35)
            for (k, r), (n, removed, digest) in zip(given.items(), want):
                text = got[k]["text"]
                assert text == r["text"] if not removed else hashlib.sha256(text.encode()).hexdigest() == digest
                assert got[k]["n_chars"] == (len(text) if removed else r["n_chars"])
            assert got.keys() == given.keys()
        elif name == "secret scans":
            scanner = secrets.SecretScanner(ranks_path())
            for k, r in given.items():
                assert (got[k]["text"] == r["text"]) == (not scanner.spans(r["text"]))
                assert not secrets.base_spans(got[k]["text"] or "")
            assert got.keys() == given.keys()
        else:
            import public_tokenizers
            from tokenizers import Tokenizer

            theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = {k: [*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 1] for k, r in given.items()}
            test_tokens.check_packing(got, ids, P.packing.Limits())
            assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in got)
        docs, given = out, got
    assert seen == [name for name, _ in P.STAGES]


def ranks_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
