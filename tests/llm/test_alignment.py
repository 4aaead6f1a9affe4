import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from evitrace.llm import alignment

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def dense(m):
    made = np.zeros((len(m.starts) - 1, m.columns), int)
    for i in range(len(m.starts) - 1):
        made[i, m.indices[m.starts[i]:m.starts[i + 1]]] = 1
    return made


def test_products_equal_dense_ones(monkeypatch):
    rng = random.Random(1)
    for block in (1 << 20, 3):
        monkeypatch.setattr(alignment, "BLOCK", block)
        for _ in range(60):
            r, k, c = (rng.randrange(1, 9) for _ in range(3))
            mats = []
            for rows, columns in ((r, k), (k, c)):
                held = [sorted(rng.sample(range(columns), rng.randrange(columns + 1))) for _ in range(rows)]
                mats.append(alignment.Csr(np.cumsum([0, *map(len, held)]), np.array(sum(held, []), int), columns))
            want = np.argwhere(dense(mats[0]) @ dense(mats[1])).tolist()
            got = [p for rows, columns in alignment.product(*mats) for p in zip(rows.tolist(), columns.tolist())]
            assert got == [tuple(w) for w in want]
            assert (dense(mats[0].transposed()) == dense(mats[0]).T).all()


def brute(rows):
    """Tokens as byte spans, all of them compared."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, shown), shown)) | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    made, counts = [], Counter()
    for i, text in rows:
        given = " " + (text or "")
        a = one.encode(given, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(t)) for t in a]
        bytes_b = [bytes([int(two.id_to_piece(t)[1:-1], 16)]) if two.is_byte(t) else two.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if b"".join(bytes_a) != given.encode() or b"".join(bytes_b) != given.encode():
            made.append((i, [], [], [], ""))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, side = 0, []
            for part in parts:
                side.append((at, at + len(part)))
                at += len(part)
            spans.append(side)
        links, j = [], 0
        for x, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[x], b[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            sides = [",".join(str(t) for t, (s, e) in zip(ids, side) if low <= s and e <= cut) for ids, side in zip((a, b), spans)] if len(text) < 3000 else ["", ""]
            groups.append("|".join(sides))
            low = cut
        made.append((i, a, b, links, ";".join(groups)))
        counts.update(links)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return {(i, len(a), len(b), g.count(";") + 1 if a else 0, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if a and len(g) > 0 else "") for i, a, b, links, g in made}


def test_query_matches_brute_force(spark):
    from evitrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = {i for i, t in rows if len(t) < 3000}
    got = QUERIES["op12_tokenizer_alignment"](spark, sf)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got, want = {tuple(r)[:8] for r in got.collect()}, brute(rows)
    assert {g[:7] for g in got} == {w[:7] for w in want}
    assert {g for g in got if g[0] in short} == {w for w in want if w[0] in short}


def test_odd_texts(spark, docs):
    texts = [None, "", " ", "  two  blanks ", "tab\there\nand\r\nthere", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve Ünïcode ﬁ   　 ①", "你好,世界 🙂👍🏽",
             "▁ lower one eighth block", "é combined \x00 \x7f", "a", "word " * 500, "no" * 40_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(11, texts[11]), (None, "id less text")]
    given = docs([(i, t, "en", "a") for i, t in rows], "n_a")
    got = {tuple(r)[:8] for r in alignment.measure(given, A, B).collect()}
    want = brute(rows)
    assert {g[:7] for g in got} == {w[:7] for w in want}
    assert {g for g in got if g[0] != 12} == {w for w in want if w[0] != 12}
    assert alignment.measure(docs([]), A, B).count() == 0


def test_shared_groups_are_counted():
    found = alignment.align(np.array([2, 3, 1]), np.array([1, 1, 2, 2]))
    assert found.group_a.tolist() == [0, 1, 1] and found.group_b.tolist() == [0, 0, 1, 1] and found.shared == 6
    assert list(zip(*(x.tolist() for x in found.links))) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 3)]


def test_products_are_formed_over_all_bytes_and_groups(monkeypatch):
    rng, real = random.Random(5), alignment.product
    for block in (1 << 16, 4):
        monkeypatch.setattr(alignment, "BLOCK", block)
        for _ in range(40):
            size = rng.randrange(1, 30)
            cut = lambda: np.diff([0, *sorted(rng.sample(range(1, size), rng.randrange(size))), size])
            one, two, formed = cut(), cut(), []

            def product(left, right):
                pairs = list(real(left, right))
                formed.append((left, right, [p for f in pairs for p in zip(*(x.tolist() for x in f))]))
                return iter(pairs)

            monkeypatch.setattr(alignment, "product", product)
            found = alignment.align(one, two)
            (left, right, links), (_, _, shared) = formed
            assert left.columns == size and dense(left).sum() == dense(right).sum() == size
            spans = [[range(e - n, e) for n, e in zip(side.tolist(), np.cumsum(side).tolist())] for side in (one, two)]
            assert links == [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if set(x) & set(y)]
            assert shared == [(i, j) for i, g in enumerate(found.group_a.tolist()) for j, h in enumerate(found.group_b.tolist()) if g == h]
            assert found.partners.tolist() == [sum(i == x for x, _ in shared) for i in range(len(one))]


def test_words_are_encoded_as_within_their_text():
    one, rng = Tokenizer.from_file(A), random.Random(3)
    one.encode_special_tokens = True
    parts = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u2002", "a", "b", "'s", "'", "é", "1", "!", "字", "\u200b", "<|endoftext|>", "x" * 40]
    texts = [" " + "".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000)]
    words = alignment._Words(A)
    got = [ids for start in range(0, len(texts), 50) for ids in words.ids(texts[start:start + 50])]
    assert got == [one.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, words.known)) <= alignment.LONG


def test_frequent_pairs_are_sent_and_rare_ones_shuffled(spark, docs, monkeypatch):
    texts = ["the cat and the dog", "the dog and a bird", None, "", "rare zyzzyva", "the the the"]
    given = docs([(i, t, "en", "a") for i, t in enumerate(texts)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent, joins in ((1 << 17, 1), (3, 2)):
            monkeypatch.setattr(alignment, "SENT", sent, raising=False)
            made = alignment.measure(given, A, B)
            # One join moves a row per text; links are shuffled only if they are of pairs not sent.
            assert made._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == joins
            assert {tuple(r)[:8] for r in made.collect()} == brute(list(enumerate(texts)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
