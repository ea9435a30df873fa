"""scriba: transcript, signal and job-event analytics on Spark."""
