"""Jobs: the stages of the pipeline, joined by dated snapshots."""
