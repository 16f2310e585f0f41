import json

from textloom.llm import copies


def lines(spark, rows):
    return copies.keyed_objects(spark.createDataFrame([(i, t, "c") for i, t in rows], "rec_id bigint, line string, canon string"), "raw", "rec_id", "line")


def texts(spark, rows):
    return copies.keyed_texts(spark.createDataFrame([(i, t, "c") for i, t in rows], "row_id bigint, text string, h1 string"), "t", "row_id", "text")


def found(keyed):
    return {(r["keep_id"], r["copy_id"]) for r in copies.copies(keyed).collect()}


def test_texts(spark):
    rows = [(5, "Ab c-1"), (3, "AB, C 1!"), (9, "abc1"), (4, "abc2"), (6, None), (7, ""), (8, " .,"), (10, "!?"), (11, "É"), (12, "é"), (None, "abc1")]
    assert found(texts(spark, rows)) == {(3, 5), (3, 9), (11, 12)}
    assert found(texts(spark, [])) == set()
    long = "word " * 200_000
    assert found(texts(spark, [(1, long), (2, long.upper())])) == {(1, 2)}


def test_objects(spark):
    a = {"id": "x-1", "query": "Some Text", "rank": 5, "source": None}
    rows = [
        (1, json.dumps(a)),
        (2, json.dumps(dict(reversed(a.items())))),
        (3, '{"ID":"X1","QUERY":"some text.","Rank":"5","source":null}'),
        (4, json.dumps({**a, "rank": 6})),
        (5, json.dumps({k: v for k, v in a.items() if v is not None})),
        (6, json.dumps({**a, "source": "null"})),
        (7, json.dumps({**a, "source": ""})),
        (8, "null"), (9, "[]"), (10, '{"id": 1'), (11, ""), (12, None), (13, "{}"), (14, " {} "), (15, '{"id": NaN}'), (16, '{"id": NaN}'),
        (17, '{"a": {"x": 1, "y": [1, 2]}}'), (18, '{"A": {"y": ["1", 2], "X": 1}}'), (19, '{"a": {"x": 1, "y": [2, 1]}}'),
        (20, "[" * 5000), (21, '{"a": 1, "a": 2}'), (22, '{"a": 2, "a": 1}'), (23, '{"a": 2}'),
    ]
    assert found(lines(spark, rows)) == {(1, 2), (1, 3), (13, 14), (17, 18), (21, 22)}


def test_hot_set_is_counted_whole(spark):
    rows = [(i, "Same text") for i in range(1, 401)] + [(i, f"other {i}") for i in range(401, 601)]
    keyed = texts(spark, rows)
    assert len(found(keyed)) == 399
    counts = {r["keep_id"]: r["copies"] for r in copies.copy_sets(keyed).collect()}
    assert counts[1] == 400 and len(counts) == 201


def test_equal_digests_are_confirmed_by_the_whole_form(spark):
    rows = [("t", 1, 7, 7, b"a"), ("t", 2, 7, 7, b"b"), ("t", 3, 7, 7, b"a"), ("t", 4, 8, 8, b"c"), ("t", 5, 8, 8, b"c")]
    assert found(spark.createDataFrame(rows, "tbl string, id bigint, h1 bigint, h2 bigint, sha binary")) == {(1, 3), (4, 5)}


def test_records_of_any_depth(spark):
    for depth in (500, 5_000, 60_000):
        deep = lambda a, b: '{"k": [' * depth + f'{{"x": 1, "{a}": "{b}"}}' + "]}" * depth
        rows = [(1, deep("y", "Some text")), (2, deep("Y", "some-text").replace(" ", "")), (3, deep("y", "other")), (4, deep("y", "Some text")[:-1])]
        assert found(lines(spark, rows)) == {(1, 2)}


def test_the_stack_parser_agrees_with_the_library():
    def plain(v):
        return [(k, plain(x)) for k, x in v.pairs] if isinstance(v, copies._Object) else [plain(x) for x in v] if isinstance(v, list) else v

    for text in ('{}', '[]', ' {"a" : [1, -2.5e+3, "x\\n", {"b": {}}, [], null, true] , "c": false} ', '0', '"s"', '[[1], [2, [3]]]', '', '{', '{"a"}', '{"a":}', '[1,]', '{"a":1,}', '[1 2]', '01', '{"a":1}}', 'nul', '[NaN]', '"\x01"', '{1: 2}'):
        try:
            want = json.loads(text, object_pairs_hook=copies._Object, parse_int=str, parse_float=str, parse_constant=copies._refuse)
        except ValueError:
            want = ValueError
        try:
            got = copies.parse_deep(text)
        except ValueError:
            got = ValueError
        assert (got is want) if want is ValueError else plain(got) == plain(want), text


def test_digest_ignores_order_of_fields_only():
    parse = copies.parse_object
    assert copies.merkle(parse('{"a":1,"b":[1,2]}')) == copies.merkle(parse('{"B":["1","2"],"A":"1"}'))
    assert copies.merkle(parse('{"a":[1,2]}')) != copies.merkle(parse('{"a":[2,1]}'))
    assert copies.merkle(parse('{"a":null}')) != copies.merkle(parse('{"a":""}'))
