import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leadrank.session import local_session  # noqa: E402

TEST_DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def as_of():
    return datetime(2026, 9, 12, 1, 0, tzinfo=timezone.utc)


@pytest.fixture
def candidate():
    return {
        "company_name": "株式会社ABC",
        "website": "https://www.example.com",
        "trigger_type": "brand_launch",
        "trigger_title": "新ブランド開始",
        "trigger_summary": "新ブランドを発表",
        "published_at": "2026-09-10",
        "source_url": "https://example.com/news/1",
        "source_title": "公式発表",
        "location": "神奈川県",
        "possible_video_need": "ブランドムービー",
    }
