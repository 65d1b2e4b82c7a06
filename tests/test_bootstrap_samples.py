from pageloom.plans import retrieval


def test_query_runs_the_reference_number_of_resamples(spark, monkeypatch):
    seen, own = [], retrieval.stats.paired_bootstrap

    def watched(details, metrics, samples=own.__defaults__[0], **more):
        seen.append(samples)
        return own(details, metrics, 3)

    monkeypatch.setattr(retrieval.stats, "paired_bootstrap", watched)
    retrieval.paired_bootstrap_ci(spark, "/root/testdata/sf0.001")
    assert seen == [5000]
