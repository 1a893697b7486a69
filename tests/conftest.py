import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("checkpoints")
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(shared)).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


STATE = ("scenario_id string, time_index int, timestamp_seconds double, track_id int, object_type string, valid boolean, center_x double, center_y double, "
         "velocity_x double, velocity_y double, heading double, length double, width double, is_sdc boolean")


def state(scenario="s", t=0, track=0, x=0.0, y=0.0, vx=0.0, vy=0.0, h=0.0, length=4.5, width=2.0, kind="TYPE_VEHICLE", valid=True):
    return (scenario, t, t * 0.1, track, kind, valid, x, y, vx, vy, h, length, width, track == 0)


@pytest.fixture(scope="session")
def states_df(spark):
    return lambda rows: spark.createDataFrame(rows, STATE)
