"""vessel_flow: AIS position records -> freight CO2 emission tables on Spark.

Main entry points:

* ``emission_pipeline`` / ``build_stages`` - the whole plan (plans.pipeline);
* ``run_emission_job`` - pending periods only, with sinks and done markers;
* ``incremental_ingest`` - new daily CSV files -> typed Parquet (streaming);
* ``Params`` - fixed reference values and engine choices.
"""

from .params import DEFAULT, Params
from .plans.job import run_emission_job
from .plans.pipeline import build_stages, emission_pipeline
from .streaming import incremental_ingest

__all__ = ["DEFAULT", "Params", "build_stages", "emission_pipeline", "incremental_ingest",
           "run_emission_job"]
