import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from likerec.session import RUNTIME_SETTINGS

    builder = SparkSession.builder.master("local[4]").appName("tests")
    settings = {**RUNTIME_SETTINGS, "spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false",
                # Tiny inputs: compiling each plan would take most of the time.
                "spark.sql.codegen.wholeStage": "false",
                "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def runtime_settings(request):
    """Each test starts with the settings that every job relies on, whatever an earlier one has left."""
    if "spark" in request.fixturenames:
        from likerec.session import tune

        tune(request.getfixturevalue("spark"))


LIKES = "user_id long, song_id long, created_at timestamp_ntz"
SONGS = ("id long, video_id string, title string, artist string, genre string, tags string, "
         "updated_at timestamp_ntz")
USERS = ("id long, user_id string, name string, email string, created_at timestamp_ntz, "
         "updated_at timestamp_ntz")
REQUESTS = "request_id long, ts timestamp_ntz, user_id string, songs array<string>, genre string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
