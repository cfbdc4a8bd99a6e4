"""triweave: three-feed document reconciliation and corpus preparation as Spark jobs."""
