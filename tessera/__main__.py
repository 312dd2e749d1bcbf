from tessera.cli import main

raise SystemExit(main())
