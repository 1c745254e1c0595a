"""Pieces keep their place and can be put together again."""

from verdigris.llm import pieces


def test_pieces_keep_columns_and_rejoin(spark):
    rows = [(1, "ngắn", "3", None), (2, None, "4", 1), (3, "", None, 2), (4, "x" * 3000, "5", 3), (5, "Khoản này. " * 400, " 6 ", 4)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, article_number string, clause_number int")
    out = pieces.all_pieces(df, keep=("article_number", "clause_number")).collect()
    assert {(r.row_id, r.article_number, r.clause_number) for r in out} == {(i, a, c) for i, t, a, c in rows if t is not None}
    again = {r.row_id: r for r in pieces.rejoined(pieces.all_pieces(df)).collect()}
    import hashlib

    assert {i: r.content_hash for i, r in again.items()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t, *_ in rows if t is not None}
    assert all(r.within_limit and r.overlap_kept for r in again.values()) and again[5].n_pieces > 3
