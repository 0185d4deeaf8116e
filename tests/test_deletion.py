"""Deletion along foreign keys: cascades, cleared keys, orphans, circles and chains."""

from runlake.operators.deletion import SET_NULL, Reference, delete_along


def ids(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cascade_and_set_null(spark):
    make = spark.createDataFrame
    tables = {"script": (make([(1,), (2,)], "s int"), "s"), "job": (make([(10, 1, 7), (11, 2, 7), (12, 2, 8), (13, None, None)], "j int, s int, u int"), "j"),
              "value": (make([(10, "a"), (11, "b"), (99, "orphan"), (None, "none")], "j int, v string"), None),
              "user": (make([(7,), (8,)], "u int"), "u")}
    refs = [Reference("job", "s", "script"), Reference("job", "u", "user", SET_NULL), Reference("value", "j", "job")]
    left = delete_along(tables, refs, {"script": make([(1,), (5,)], "s int"), "user": make([(7,)], "u int")})
    assert ids(left["script"]) == [(2,)] and ids(left["user"]) == [(8,)]
    assert ids(left["job"]) == [(11, 2, None), (12, 2, 8), (13, None, None)]
    assert ids(left["value"]) == [(11, "b"), (99, "orphan"), (None, "none")]
    assert left["job"].columns == ["j", "s", "u"]
    same = delete_along(tables, refs, {})
    assert all(ids(same[t]) == ids(tables[t][0]) for t in tables)


def test_circles_are_followed_to_the_end(spark):
    make = spark.createDataFrame
    # a chain inside one table, and a circle over two tables
    node = make([(i, i - 1 if i % 10 else None, i // 10) for i in range(60)], "n int, up int, g int")
    group = make([(g, 10 * g + 3) for g in range(7)], "g int, head int")
    refs = [Reference("node", "up", "node"), Reference("node", "g", "group"), Reference("group", "head", "node")]
    tables = {"leaf": (make([(i, i) for i in range(60)], "l int, n int"), "l"), "node": (node, "n"), "group": (group, "g")}
    left = delete_along(tables, [*refs, Reference("leaf", "n", "node")], {"node": make([(13,), (25,)], "n int")})
    # 13 takes its chain to 19, and with the head of group 1 the whole group; 25 only takes its chain
    want = [i for i in range(60) if i // 10 != 1 and not 25 <= i <= 29]
    assert sorted(r[0] for r in left["node"].collect()) == want
    assert sorted(r[0] for r in left["leaf"].collect()) == want
    assert [r[0] for r in ids(left["group"])] == [0, 2, 3, 4, 5, 6]
