"""One row of each near-duplicate group, whatever its ids."""

from parcelspark.llm import minhash


def test_one_of_each_with_null_and_repeated_ids(spark):
    def near(name):
        return [" ".join(f"{name}{j}" for j in range(200)) + f" end{i}" for i in range(4)]

    rows = [(None, t) for t in near("a")] + [(5, t) for t in near("b")] + [(None, t) for t in near("c")] + [(9, near("c")[0]), (None, "alone and without a copy in the table"), (None, ""), (3, " ")]
    kept = [tuple(r) for r in minhash.one_of_each(spark.createDataFrame([*rows, *rows], "doc_id long, text string")).collect()]
    by = sorted((k or 0, t[:2]) for k, t in kept)
    assert by == [(0, ""), (0, "a0"), (0, "al"), (3, " "), (5, "b0"), (9, "c0")]
