from rtflow.plans.dataflow import build, job_order
from rtflow.plans.jobs import Job, load_jobs

__all__ = ["Job", "build", "job_order", "load_jobs"]
