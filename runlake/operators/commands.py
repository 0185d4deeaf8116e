"""Job command log folding, job cloning and command-line parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.shell import let, shell_tokens
from runlake.operators.access import script_rule
from runlake.operators.jobs import REVOKED, SUBMITTED, DELETED
from runlake.operators.joins import shuffled
from runlake.operators.ranking import row_number_by

# Commands of the job command endpoint and the status they set.
COMMAND_STATUS = {"rerun": SUBMITTED, "delete": DELETED, "stop": REVOKED}
ERR_UNKNOWN = "Unknown Command"
ERR_JOB = "Unknown Job"


def apply_commands(jobs: DataFrame, log: DataFrame, users: DataFrame, scripts: DataFrame,
                   allow_anonymous: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold a command log (cmd_id, job_id, user_id, command) into the jobs (with script_id).

    The requester must be permitted to use the job's script, and own the job
    unless nobody does.  Status commands (rerun, delete, stop) apply in log
    order, the last one wins; a rerun also counts a new attempt; every allowed
    resubmit creates a new job (see ``clone_jobs``).  Returns (jobs, resubmits,
    errors); errors are (cmd_id, error), one for every command not done: an
    unknown job, the refusal of the script rule, '' for a job of somebody
    else, an unknown command.
    """
    j = jobs.select("job_id", F.col("user_id").alias("owner_id"), "script_id", F.lit(True).alias("found"))
    lg = script_rule(log.select("cmd_id", "job_id", "user_id", "command").join(j, "job_id", "left"), users, scripts, allow_anonymous)
    found = F.coalesce("found", F.lit(False))
    owned = F.col("owner_id").isNull() | F.coalesce(F.col("user_id") == F.col("owner_id"), F.lit(False))
    known = F.coalesce(F.col("command").isin("resubmit", *COMMAND_STATUS), F.lit(False))
    error = F.when(~found, ERR_JOB).when(~F.col("permitted"), F.col("refusal")).when(~owned, "").when(~known, ERR_UNKNOWN)
    lg = lg.withColumn("error", error)
    errors = lg.filter(F.col("error").isNotNull()).select("cmd_id", "error")
    ok = lg.filter(F.col("error").isNull())
    status_map = F.create_map(*[F.lit(x) for kv in COMMAND_STATUS.items() for x in kv])
    per_job = (ok.filter(F.col("command") != "resubmit")
                 .groupBy("job_id")
                 .agg(F.max_by(status_map[F.col("command")], "cmd_id").alias("_status"),
                      F.count_if(F.col("command") == "rerun").alias("reruns")))
    new_jobs = jobs.join(per_job, "job_id", "left").select(
        *[F.coalesce("_status", "status").alias("status") if c == "status" else F.col(c) for c in jobs.columns],
        F.coalesce("reruns", F.lit(0)).alias("reruns"))
    resubmits = ok.filter(F.col("command") == "resubmit").select("cmd_id", "job_id", "user_id")
    return new_jobs, resubmits, errors


def clone_jobs(jobs: DataFrame, params: DataFrame, requests: DataFrame, id_base) -> tuple[DataFrame, DataFrame]:
    """Copy jobs and their parameter rows under new ids (request order after
    ``id_base``).  The clone belongs to the requester, has no task id and
    empty logs; output-file values are moved to the new job's folder, input
    files are shared."""
    numbered = row_number_by(requests, [], ["request_id"], name="_k")
    numbered = numbered.withColumn("new_job_id", F.col("_k") + id_base)
    cloned = (numbered.join(shuffled(jobs), "job_id").select(
        "new_job_id", F.col("job_id").alias("source_job_id"), F.col("requester_id").alias("user_id"),
        F.lit(SUBMITTED).alias("status"), F.lit(None).cast("string").alias("celery_id"),
        F.lit("").alias("stdout"), F.lit("").alias("stderr")))
    p = numbered.select("job_id", "new_job_id").join(shuffled(params), "job_id")
    is_out = F.coalesce(F.col("is_output"), F.lit(False)) if "is_output" in params.columns else F.lit(False)
    value = F.when(is_out, F.regexp_replace(F.col("raw"), r"(^|/)" + r"jobs/[0-9]+/",
                                            F.concat(F.lit("$1jobs/"), F.col("new_job_id").cast("string"), F.lit("/"))))
    new_params = p.select(F.col("new_job_id").alias("job_id"), *[
        F.coalesce(value, F.col("raw")).alias("raw") if c == "raw" else F.col(c)
        for c in params.columns if c != "job_id"])
    return cloned, new_params


# ------------------------------------------------------------ command lines
NEGATIVE = r"^-\d+$|^-\d*\.\d+$"        # fixed value: values that look like options
SUBPARSER = "subparser"


def option_table(spec: DataFrame) -> DataFrame:
    """One row per script: what a command of it may hold.

    ``spec`` has script_id, parser ('' is the main one), dest, flag ('' for a
    positional), nargs ('0', '1', '?', '*' or '+'), required, default and
    position.  ``options`` maps parser and option text to (flag, dest, nargs);
    a long option is also found by every unique beginning of it.  Positionals
    are listed by parser and order.  The table has as many entries as the
    script has parameters and letters in their flags."""
    flagged = spec.where("flag <> ''")
    size = F.length("flag")
    begins = F.when(F.startswith("flag", F.lit("--")) & (size > 3), F.transform(
        F.sequence(F.lit(3), size - 1), lambda n: F.substr("flag", F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    texts = flagged.select("script_id", "parser", "flag", "dest", "nargs", F.explode(F.concat(F.array("flag"), begins)).alias("text"))
    named = texts.groupBy("script_id", "parser", "text").agg(
        F.max_by(F.struct("flag", "dest", "nargs"), F.col("text") == F.col("flag")).alias("o"),
        F.bool_or(F.col("text") == F.col("flag")).alias("exact"), F.count_distinct("flag").alias("n"),
        F.array_join(F.array_sort(F.collect_set("flag")), ", ").alias("all"))
    named = named.select("script_id", F.concat("parser", F.lit("\n"), "text").alias("key"), F.struct(
        "o.flag", "o.dest", "o.nargs", F.when(~F.col("exact") & (F.col("n") > 1), F.col("all")).alias("ambiguous")).alias("option"))
    options = named.groupBy("script_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "option"))).alias("options"))
    placed = spec.where("flag = ''").groupBy("script_id").agg(
        F.array_sort(F.collect_list(F.struct("parser", "position", "dest", "nargs"))).alias("positionals"))
    rules = spec.groupBy("script_id").agg(
        F.array_sort(F.collect_list(F.struct("parser", "position", "dest", "flag", "required", "default"))).alias("rules"),
        F.array_sort(F.collect_set(F.when(F.col("parser") != "", F.col("parser")))).alias("parsers"))
    return rules.join(shuffled(options), "script_id", "left").join(shuffled(placed), "script_id", "left").select(
        "script_id", "rules", "parsers", F.coalesce("options", F.create_map().cast(named_map(named))).alias("options"),
        F.coalesce("positionals", F.array().cast(placed.schema["positionals"].dataType)).alias("positionals"))


def named_map(named: DataFrame) -> str:
    return f"map<string,{named.schema['option'].dataType.simpleString()}>"


def _scan(tokens: Column, options: Column, positionals: Column, parsers: Column) -> Column:
    """Fold over the tokens: which option or positional each belongs to.

    The state holds the parser, the option that still takes values (``open``;
    ``left`` values, ``need`` one more), the number of positionals seen, the
    assignments made, what nobody takes, and the first error."""
    text = lambda s: F.lit(s).cast("string")
    made = "array<struct<dest:string,turn:int,value:string>>"
    begin = F.struct(
        F.lit("").alias("parser"), text(None).alias("open"), text(None).alias("flag"), F.lit(0).alias("left"), F.lit(False).alias("need"),
        text(None).alias("nargs"), F.lit(0).alias("turn"), F.lit(0).alias("placed"), F.lit(False).alias("plain"),
        F.array().cast(made).alias("made"), F.array().cast("array<string>").alias("extras"), text(None).alias("error"))
    names = ["parser", "open", "flag", "left", "need", "nargs", "turn", "placed", "plain", "made", "extras", "error"]

    def state(acc: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, acc[n]).alias(n) for n in names])

    def assigned(acc: Column, dest: Column, turn: Column, value: Column) -> Column:
        return F.concat(acc["made"], F.array(F.struct(dest.alias("dest"), turn.alias("turn"), value.alias("value"))).cast(made))

    def starved(acc: Column) -> Column:
        """Error of an open option that had to take a value."""
        return F.when(acc["need"], F.concat(F.lit("argument "), acc["flag"], F.when(
            acc["nargs"] == "+", F.lit(": expected at least one argument")).otherwise(F.lit(": expected one argument"))))

    closed = {"open": text(None), "need": F.lit(False), "left": F.lit(0)}

    def step(acc: Column, t: Column) -> Column:
        def option(o: Column) -> Column:
            """``o`` is (found, value): the option of a token and the value written with it."""
            found, value, turn = o["found"], o["value"], acc["turn"] + 1
            takes = found["nargs"]
            error = F.coalesce(starved(acc), F.when(found["ambiguous"].isNotNull(), F.concat(
                F.lit("ambiguous option: "), t, F.lit(" could match "), found["ambiguous"])),
                F.when((takes == "0") & value.isNotNull(), F.concat(F.lit("argument "), found["flag"],
                                                                     F.lit(": ignored explicit argument '"), value, F.lit("'"))))
            shut = value.isNotNull() | (takes == "0")
            now = F.when(shut, F.coalesce(value, F.lit("True")))
            return F.when(error.isNotNull(), state(acc, error=error)).otherwise(state(
                acc, turn=turn, flag=found["flag"], nargs=takes, error=text(None), open=F.when(~shut, found["dest"]),
                left=F.when(shut, 0).when(takes.isin("1", "?"), 1).otherwise(-1), need=~shut & takes.isin("1", "+"),
                # an option without values is still set: a null value stands for it
                made=F.when(shut | takes.isin("?", "*"), assigned(acc, found["dest"], turn, now)).otherwise(acc["made"])))

        def argument(acc: Column) -> Column:
            takes = acc["open"].isNotNull()
            value = state(acc, made=assigned(acc, acc["open"], acc["turn"], t), need=F.lit(False), left=acc["left"] - 1,
                          open=F.when(acc["left"] != 1, acc["open"]))
            mine = F.filter(positionals, lambda p: p["parser"] == acc["parser"])

            def positional(mine: Column) -> Column:
                last = F.get(mine, F.size(mine) - 1)
                many = (F.size(mine) > 0) & last["nargs"].isin("*", "+") & (acc["placed"] >= F.size(mine))
                slot = F.when(many, last).otherwise(F.get(mine, acc["placed"]))
                chooses = (acc["parser"] == "") & (F.size(parsers) > 0) & (acc["placed"] == F.size(mine)) & ~many
                chosen = F.when(F.array_contains(parsers, t), state(
                    acc, parser=t, placed=F.lit(0), made=assigned(acc, F.lit(SUBPARSER), F.lit(0), t))).otherwise(state(
                        acc, error=F.concat(F.lit("argument "), F.lit(SUBPARSER), F.lit(": invalid choice: '"), t,
                                            F.lit("' (choose from "), F.array_join(parsers, ", "), F.lit(")"))))
                placed = state(acc, placed=acc["placed"] + 1, made=assigned(acc, slot["dest"], F.lit(0), t))
                return F.when(chooses, chosen).when(slot.isNotNull(), placed).otherwise(
                    state(acc, extras=F.concat(acc["extras"], F.array(t))))

            return F.when(takes, value).otherwise(let(mine, positional))

        at = lambda x: F.try_element_at(options, F.concat(acc["parser"], F.lit("\n"), x))
        whole, before, two = at(t), at(F.substring_index(t, "=", 1)), at(F.substr(t, F.lit(1), F.lit(2)))
        with_equals = F.contains(t, F.lit("="))
        short = ~F.startswith(t, F.lit("--")) & (F.length(t) > 2)
        resolved = F.when(whole.isNotNull(), F.struct(whole.alias("found"), text(None).alias("value"))) \
            .when(with_equals & before.isNotNull(), F.struct(before.alias("found"), F.substr(t, F.instr(t, "=") + 1).alias("value"))) \
            .when(short & two.isNotNull(), F.struct(two.alias("found"), F.substr(t, F.lit(3)).alias("value")))
        dashed = ~acc["plain"] & F.startswith(t, F.lit("-")) & (F.length(t) > 1)
        unknown = F.when(t.rlike(NEGATIVE) | F.contains(t, F.lit(" ")), argument(acc)).when(
            starved(acc).isNotNull(), state(acc, error=starved(acc))).otherwise(
            state(acc, extras=F.concat(acc["extras"], F.array(t)), **closed))
        ends = F.when(starved(acc).isNotNull(), state(acc, error=starved(acc))).otherwise(state(acc, plain=F.lit(True), **closed))
        return F.when(acc["error"].isNotNull(), acc).when(dashed & (t == "--"), ends).when(
            dashed, let(resolved, lambda o: F.when(o.isNotNull(), option(o)).otherwise(unknown))).otherwise(argument(acc))

    return F.aggregate(tokens, begin, step, lambda acc: state(acc, error=F.coalesce(acc["error"], starved(acc))))


def parse_commands(commands: DataFrame, spec: DataFrame, key: str = "job_id") -> DataFrame:
    """Command lines (``key``, script_id, command) parsed by the specification of their script.

    Gives (``key``, dest, position, value, origin): one row per value, with origin
    ``command`` or ``default``; an option given again replaces its earlier
    values; one without values has position 0 and a null value.  A command that cannot
    be parsed gives one row of origin ``error`` with the message as value:
    the first of bad quoting, a script without specification, a wrong option or choice,
    missing required arguments, arguments nobody takes.  Commands meet their
    script's specification in one equi-join and are scanned inside their row.
    """
    told = commands.select(F.col(key), "script_id", shell_tokens(F.coalesce("command", F.lit(""))).alias("t")) \
        .join(shuffled(option_table(spec)), "script_id", "left")
    known = F.col("rules").isNotNull() & F.col("t.error").isNull()
    read = told.withColumn("s", F.when(known, _scan(F.col("t.tokens"), F.col("options"), F.col("positionals"), F.col("parsers"))))
    live = read.withColumn("live", F.filter("rules", lambda r: (r["parser"] == "") | (r["parser"] == F.col("s.parser"))))
    given = F.transform("s.made", lambda m: m["dest"])
    missing = F.filter("live", lambda r: r["required"] & ~F.array_contains(given, r["dest"]))
    names = F.array_join(F.transform(missing, lambda r: F.when(r["flag"] != "", r["flag"]).otherwise(r["dest"])), ", ")
    error = F.coalesce(
        F.col("t.error"), F.when(F.col("rules").isNull(), F.lit("unknown script")), F.col("s.error"),
        F.when(F.size(missing) > 0, F.concat(F.lit("the following arguments are required: "), names)),
        F.when(F.size("s.extras") > 0, F.concat(F.lit("unrecognized arguments: "), F.array_join("s.extras", " "))))
    # the last turn of an option counts
    last = F.filter("s.made", lambda m: ~F.exists("s.made", lambda o: (o["dest"] == m["dest"]) & (o["turn"] > m["turn"])))
    valued = F.filter(last, lambda m: m["value"].isNotNull() | ~F.exists(
        "s.made", lambda o: (o["dest"] == m["dest"]) & (o["turn"] == m["turn"]) & o["value"].isNotNull()))
    ranked = F.transform(valued, lambda m, i: F.struct(
        m["dest"].alias("dest"), F.when(m["value"].isNotNull(), F.size(F.filter(F.slice(valued, F.lit(1), i + 1), lambda o: (
            o["dest"] == m["dest"]) & o["value"].isNotNull()))).otherwise(0).alias("position"), m["value"].alias("value"),
        F.lit("command").alias("origin")))
    defaults = F.transform(F.filter("live", lambda r: r["default"].isNotNull() & ~F.array_contains(given, r["dest"])), lambda r: F.struct(
        r["dest"].alias("dest"), F.lit(1).alias("position"), r["default"].alias("value"), F.lit("default").alias("origin")))
    failed = F.array(F.struct(F.lit(None).cast("string").alias("dest"), F.lit(0).alias("position"), error.alias("value"),
                              F.lit("error").alias("origin")))
    rows = F.when(error.isNotNull(), failed).otherwise(F.concat(ranked, defaults))
    return live.select(F.col(key), F.inline(rows))
