"""Token alignment against a brute-force version that encodes every text whole and walks all token spans."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from imprintmatch.llm import align

TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "the quick  brown\n\nfox   jumps \tover", "naïve café – Größe, ça va? 你好 世界 🙂🙃 é", "<|endoftext|> and <s> and </s> are text", "a▁b is not given back", "",
    None, " ", "  two before", "one after ", "\n", "\nline first", "x" * 3000, "don't we'll I'm 12345 3.14 ½", "tab\tand\r\nline", "nul\0inside", "word " * 500 + "end", "The quick brown fox jumps over the lazy dog.", " nbsp 　wide", "co-operate re-use un-do",
]


def brute(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in codes}
    for k, b in enumerate(b for b in range(256) if b not in codes):
        table[chr(256 + k)] = b

    def spans(ids, word):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(word(i))))
            at += len(word(i))
        return out, b"".join(map(word, ids))

    def bytes_b(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    rows = []
    for text in texts:
        text = text or ""
        a, joined_a = spans(a_side.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(table[c] for c in a_side.id_to_token(i)))
        b, joined_b = spans(b_side.encode(text), bytes_b)
        if not text or not joined_a == joined_b == (" " + text).encode():
            rows.append(([], [], [], []))
            continue
        links, j = [], 0
        for i, start, stop in a:
            while b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < stop:
                links.append((i, b[k][0]))
                k += 1
        groups, done = [], 0
        for end in sorted({x[2] for x in a} & {x[2] for x in b}):
            groups.append(tuple([i for i, s, e in side if done < e <= end] for side in (a, b)) if len(text) < 100 else None)
            done = end
        rows.append((a, b, groups, links))
    count = Counter(pair for *_, links in rows for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for a, b, groups, links in rows:
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups) if None not in groups else None
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield {"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": len(links), "n_best": sum(count[p] == best[p[0]] for p in links), "count_sum": sum(count[p] for p in links), "groups_sha256": digest}


def check(found, texts, ids=None):
    found = sorted((r.asDict() for r in found.collect()), key=lambda r: r["doc_id"])
    assert len(found) == len(texts)
    for row, wanted in zip(found, brute(texts)):
        row.pop("doc_id")
        if wanted["groups_sha256"] is None:
            row["groups_sha256"] = None
        assert row == wanted


def test_alignment_equals_brute_force(make_docs):
    check(align.align_tokens(make_docs(TEXTS)), TEXTS)


def test_counts_by_join_equal_counts_by_broadcast(make_docs):
    docs = make_docs(TEXTS)
    check(align.align_tokens(docs, most_broadcast=0), TEXTS)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    check(align.align_tokens(docs), texts)


@pytest.mark.parametrize("most", [align.MOST_BROADCAST, 0])
def test_no_rows_repeated_rows_and_clashing_columns(make_docs, most):
    docs = make_docs(["one two", "one two", None], ids=[3, 3, None]).selectExpr("*", "1 as row", "'x' as pairs", "2 as n_a", "3 as pair", "4 as `count`")
    rows = align.align_tokens(docs, most_broadcast=most).collect()
    assert len(rows) == 3 and {r.doc_id for r in rows} == {3, None}
    assert [r.count_sum for r in rows if r.doc_id == 3] == [2 * r.n_links for r in rows if r.doc_id == 3]
    assert align.align_tokens(docs.limit(0), most_broadcast=most).count() == 0
    assert align.align_tokens(make_docs([None, ""]), most_broadcast=most).agg({"n_a": "sum"}).first()[0] == 0


def test_pieces_word_by_word_equal_whole_texts():
    both = align.Pieces(align.default_pieces())
    ids, counts = both.encode(pa.array([t or "" for t in TEXTS]))
    whole = [both.model.encode(t or "") for t in TEXTS]
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]
