"""spark-submit entry point for the batch jobs (same CLI as ``python -m tidewatch``)."""

from tidewatch.plans.jobs import main

if __name__ == "__main__":
    main()
