"""No operator of this engine needs a stream: all windows are point-in-time over history.

The package is kept for sources that append; ``lagweave.operators.asof`` accepts any
DataFrame, and a micro-batch given to it by ``foreachBatch`` is one."""
