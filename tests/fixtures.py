"""Small knowledge bases with known results."""


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"a{i} int" for i in range(len(rows[0]))))


def kb(spark, relations, n=None):
    from hornpress.operators.kb import Kb

    return Kb.of("test", {k: frame(spark, v) for k, v in relations.items()}, n)


KIN = {
    "father": [(5, 10), (6, 11), (6, 15), (7, 12), (8, 16)],
    "parent": [(5, 10), (5, 14), (6, 11), (6, 15), (9, 15), (1, 5), (2, 6), (2, 9), (3, 7)],
    "grandParent": [(1, 10), (2, 15), (4, 13)],
}

FAMILY = {
    "family": [(4, 5, 6), (7, 8, 9), (10, 11, 12), (13, 14, 15)],
    "mother": [(4, 6), (7, 9), (10, 12), (13, 15)],
    "father": [(5, 6), (8, 9), (11, 12), (16, 17)],
}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def shuffled(spark, run):
    """Records that stages wrote to a shuffle while run() ran."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)
