import pytest

from themeweave.plans.inputs import TARGET, chunks, labels, phrases
from themeweave.stages import Access, Address, Assess

SF = "/root/testdata/sf0.001"


def test_defaults():
    a = Address()
    assert (a.n_concern_clusters, a.n_benefit_clusters, a.random_seed, a.tech_col, a.cross_cutting_threshold, a.soft_membership_threshold, a.validation_sample_n) == (75, 75, 42, "technology_meta", 0.5, 0.3, 250)
    b = Access()
    assert (b.min_chunk_words, b.max_chunk_words, b.min_chunk_chars) == (40, 500, 80)
    with pytest.raises(ValueError):
        a.n_clusters("risk")


def test_stages_over_the_tables(spark, tmp_path):
    p, ch = phrases(spark, SF), chunks(spark, SF)
    a = Address(ai_tech_label=TARGET)
    assert a.profile(p, "concern").count() == 75
    m = a.year_matrix(p, ch)
    assert m.count() > 0 and m.filter("fraction < 0 OR fraction > 1").count() == 0
    assert a.distinctive(p, labels(p), 3).count() == 6
    assert a.validation_sample(ch, p).count() <= 375
    assert set(Assess().quality(ch)) == {"technology", "year", "document", "words"}
    x = Assess(Access(output_folder=str(tmp_path))).validation_summary(spark)
    assert x.filter("status = 'OK'").count() == 0
