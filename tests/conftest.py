import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from remitlake.session import local_session  # noqa: E402
from remitlake.sources.schemas import TABLES, typed_schema  # noqa: E402
from remitlake.sources.silver import Silver  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="run-warehouse-", dir="/tmp")
    session = local_session(8, "remitlake-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": warehouse,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-checkpoints-", dir="/tmp"),
        "spark.sql.maxMetadataStringLength": "2000",
    })
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def make_silver(spark):
    """Tables from lists of dicts; missing tables are empty, missing columns NULL."""

    def build(**rows):
        frames = {}
        for table, columns in TABLES.items():
            data = [tuple(r.get(c) for c, _ in columns) for r in rows.get(table, [])]
            frames[table] = spark.createDataFrame(data, typed_schema(table))
        return Silver(frames)

    return build


def claim(i, **values):
    """A paid claim of payer A in encounter ``e<i>`` on 2024-01-10 over 100."""
    base = {
        "claim_id": f"c{i}", "encounter_id": f"e{i}", "patient_id": "p1", "payer_id": "A",
        "date_of_service": "2024-01-10", "submission_date": "2024-01-20", "total_charge_amount": 100.0,
        "claim_status": "Paid", "is_clean_claim": 1,
    }
    return base | values


def encounter(i, **values):
    base = {
        "encounter_id": f"e{i}", "patient_id": "p1", "provider_id": "d1", "date_of_service": "2024-01-10",
        "encounter_type": "Outpatient", "department": "Heart",
    }
    return base | values


def payment(i, claim_id, amount, allowed=None, **values):
    base = {
        "payment_id": f"y{i}", "claim_id": claim_id, "payer_id": "A", "payment_amount": amount,
        "allowed_amount": allowed, "payment_date": "2024-02-05", "is_accurate_payment": 1,
    }
    return base | values


PAYER_A = {"payer_id": "A", "payer_name": "Alpha", "payer_type": "Commercial"}
PAYER_B = {"payer_id": "B", "payer_name": "Beta", "payer_type": "Self-Pay"}
PROVIDER = {"provider_id": "d1", "provider_name": "Dr One", "department": "Heart", "specialty": "Heart"}


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(df):
    (row,) = rows(df)
    return row
