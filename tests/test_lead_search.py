import pytest

from leadloom.operators.lead_search import LeadSearch, matching
from leadloom.plans.output_queries import _lead_tables


@pytest.mark.parametrize("wrong", [{"page": 0}, {"limit": 101}, {"sort_by": "phone"}, {"sort_order": "up"}, {"score_band": "TOP"}, {"min_score": 101}, {"classification_confidence": 1.5}, {"qualification_status": "MAYBE"}])
def test_questions_are_checked(wrong):
    with pytest.raises(ValueError):
        LeadSearch(1, **wrong)


def test_facets_take_one_exchange_of_ids(spark, sf_dir):
    tables = _lead_tables(spark, sf_dir)
    asked = LeadSearch(1, classification="QUALIFIED", duplicate_status="AUTO_DUPLICATE", qualification_status="QUALIFIED", contact_title="founder")
    ids = lambda **q: {r["id"] for r in matching(tables, LeadSearch(1, **q)).select("id").collect()}
    each = [ids(classification="QUALIFIED"), ids(duplicate_status="AUTO_DUPLICATE"), ids(qualification_status="QUALIFIED"), ids(contact_title="founder")]
    assert {r["id"] for r in matching(tables, asked).select("id").collect()} == set.intersection(*each)
    assert ids(has_email=True) | ids(has_email=False) == ids() and not ids(has_email=True) & ids(has_email=False)
