"""A ledger that is worked out from sightings is worked out once."""

from tessera.operators.absorb import ENTRY, absorb


def test_absorb_reads_the_ledger_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(k):
        read.add(1)
        return ("fact", f"entry number {k}", [f"entry number {k} said"], [], "2024-01-01", "2024-01-02", 2, [0.5], False, "")

    ledger = spark.createDataFrame(spark.sparkContext.parallelize(range(20), 2).map(seen), ENTRY)
    batch = spark.createDataFrame([("fact", "Entry number 3.", 0.9, "c", 1), ("fact", "something else", 0.1, "c", 2)], "kind string, statement string, confidence double, category string, ord long")
    got = {r.fingerprint: r.seen_count for r in absorb(ledger, batch, "2024-01-03").collect()}
    assert len(got) == 21 and got["entry number 3"] == 3 and got["something else"] == 1 and got["entry number 4"] == 2
    assert read.value == 20
