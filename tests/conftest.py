import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def email_row(**fields):
    base = {"email_id": 1, "from_hdr": "", "subject": "", "snippet": "", "body": "", "sender_domain": "",
            "urls": [], "url_domains": [], "spf_pass": True, "dkim_pass": True, "dmarc_pass": True,
            "has_html": False, "fingerprint": "f"}
    return base | fields


EMAIL_DDL = ("email_id long, from_hdr string, subject string, snippet string, body string, sender_domain string, "
             "urls array<string>, url_domains array<string>, spf_pass boolean, dkim_pass boolean, "
             "dmarc_pass boolean, has_html boolean, fingerprint string")


@pytest.fixture(scope="session")
def make_emails(spark):
    names = [c.split()[0] for c in EMAIL_DDL.split(", ")]

    def make(*rows):
        full = [email_row(**{"email_id": i} | r) for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], EMAIL_DDL)
    return make
