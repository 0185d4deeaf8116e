"""Command lines: the tokenizer against shlex, the parser against argparse."""

import argparse
import random
import shlex

from pyspark.sql import functions as F

from runlake.functions.shell import shell_tokens
from runlake.operators.commands import parse_commands

SPEC = "script_id int, parser string, dest string, flag string, nargs string, required boolean, default string, position int"
RULES = [(1, "", "status", "--status", "1", True, None, 0), (1, "", "stop", "--stop", "0", False, None, 1),
         (1, "", "name", "", "1", True, None, 2), (1, "", "num", "-n", "*", False, None, 3), (1, "", "opt", "--opt-in", "?", False, "d", 4),
         (1, "sub", "total", "--total", "+", True, None, 5), (1, "sub", "q", "-q", "1", False, "7", 6),
         (1, "sub", "where", "", "1", True, None, 7)]


class Failed(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Failed(message)


def reference():
    """The same rules for argparse."""
    main = Parser(add_help=False)
    subs, parsers = None, {"": main}
    for _, parser, dest, flag, nargs, required, default, _ in RULES:
        if parser and subs is None:
            subs = main.add_subparsers(dest="subparser", parser_class=lambda **k: Parser(add_help=False, **k))
        if parser not in parsers:
            parsers[parser] = subs.add_parser(parser)
        if not flag:
            parsers[parser].add_argument(dest)
        elif nargs == "0":
            parsers[parser].add_argument(flag, dest=dest, action="store_const", const="True")
        else:
            parsers[parser].add_argument(flag, dest=dest, nargs=None if nargs == "1" else nargs, required=required, default=default)
    return main


def test_tokens_equal_shlex(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(['"', "'", "\\", " ", "a", "b\n", "\u00e9", "--x=", "\t"]) for _ in range(rng.randint(0, 12)))
             for _ in range(2000)] + ["x" * 100_000 + " '" + "y " * 50_000 + "'"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", shell_tokens(F.col("t")).alias("s"))
    for r in df.collect():
        try:
            want = (shlex.split(r["t"]), None)
        except ValueError as e:
            want = (None, str(e))
        assert (r["s"]["tokens"], r["s"]["error"]) == want, r["t"]


def test_values_equal_argparse(spark):
    rng = random.Random(3)
    words = ["--status", "--status", "F", "--status=G", "--sta", "--st", "--stop", "bob", "bob", "sub", "--total", "1", "-2", "-n", "-n5",
             "--opt-in", "--opt", "-q", "-q9", "--bogus", "'a b'", "here", "--total=3", "-3.5", "--stop=1", "-x"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    lines += [f"--status F bob sub --total {t} there" for t in ("1 2 -q 3", "1 -q 3", "=4", "1 --total 5 6 -q 1")]
    lines += [f"--status F {a} bob" for a in ("--stop", "--opt-in x", "--opt-in --stop", "-n --stop", "-n 1 2 --", "-n4")]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(lines)], "job_id int, script_id int, command string")
    got = {}
    for r in parse_commands(df, spark.createDataFrame(RULES, SPEC)).collect():
        got.setdefault(r["job_id"], []).append(r)
    parsed = 0
    for i, line in enumerate(lines):
        rows, failed = got.get(i, []), None
        try:
            want = vars(reference().parse_args(shlex.split(line)))
        except Failed as e:
            failed = str(e)
        if failed is not None:
            assert [r["origin"] for r in rows] == ["error"], (line, failed, rows)
            continue
        parsed += 1
        have = {}
        for r in sorted(rows, key=lambda r: r["position"]):
            have.setdefault(r["dest"], []).append(r["value"])
        for dest, value in want.items():
            mine = have.pop(dest, [None])
            assert mine == (value if isinstance(value, list) and value else [None] if value in (None, []) else [value]), (line, dest, rows)
        assert not have, (line, have)
    assert parsed > 20


def test_messages_and_unknown_scripts(spark):
    lines = [("--st x", "ambiguous option: --st could match --status, --stop"), ("--status", "argument --status: expected one argument"),
             ("--status F", "the following arguments are required: name"), ("--status F bob sub --total", "argument --total: expected at least one argument"),
             ("--status F bob --stop=1", "argument --stop: ignored explicit argument '1'"), ("--status F bob -x", "unrecognized arguments: -x"),
             ("--status F bob away", "argument subparser: invalid choice: 'away' (choose from sub)"), ("'", "No closing quotation"),
             ("a\\", "No escaped character"), (None, "the following arguments are required: --status, name")]
    rows = [(i, 1, t) for i, (t, _) in enumerate(lines)] + [(99, 5, "x")]
    got = {r["job_id"]: r["value"] for r in parse_commands(spark.createDataFrame(rows, "job_id int, script_id int, command string"),
                                                           spark.createDataFrame(RULES, SPEC)).where("origin = 'error'").collect()}
    assert got == {**{i: m for i, (_, m) in enumerate(lines)}, 99: "unknown script"}
