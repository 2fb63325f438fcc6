"""dagframe: flow graphs, tool queries and event-log views as Spark DataFrame programs."""
