"""scanfleet: Spark operators for fleets of LiDAR, IMU and trajectory logs."""
