"""Licence families, their names and texts, and sentences that are no notices: what operator 6 learns from."""

from __future__ import annotations

#: Families, names by which notices call them, and paragraphs of their texts.
FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    "Apache-2.0": (
        ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache-2.0 license", "Apache 2.0 license", "Apache Software License, Version 2.0", "Apache License version 2", "ASL 2.0", "Apache 2.0"],
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ],
    ),
    "MIT": (
        ["MIT License", "MIT license", "The MIT License (MIT)", "Expat License", "X11/MIT license", "MIT-style license", "MIT"],
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ],
    ),
    "BSD": (
        ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause license", "New BSD License", "Simplified BSD License", "BSD-style license", "three-clause BSD license", "Modified BSD License"],
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ],
    ),
    "ISC": (
        ["ISC License", "ISC license", "ISC", "Internet Systems Consortium License"],
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
        ],
    ),
    "BSL-1.0": (
        ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0", "Boost license"],
        [
            "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        ],
    ),
    "Zlib": (
        ["zlib License", "zlib/libpng License", "Zlib license", "zlib"],
        [
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
            "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        ],
    ),
    "GPL-2.0": (
        ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPL version 2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+", "GPL-2.0 license", "GPLv2", "GPLv2 license", "GPL version 2", "GPL v2"],
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        ],
    ),
    "GPL-3.0": (
        ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPL version 3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+", "GPL-3.0 license", "GPLv3", "GPLv3 license", "GPL version 3", "GPL v3"],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
        ],
    ),
    "LGPL": (
        ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU Library General Public License", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-2.1 license", "LGPL-3.0 license", "LGPLv3", "LGPLv2.1", "LGPLv3 license", "GNU LGPL"],
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU Lesser General Public License along with this library",
        ],
    ),
    "AGPL": (
        ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU Affero General Public License", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0 license", "AGPLv3", "AGPLv3 license", "GNU AGPL v3", "GNU AGPL"],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU Affero General Public License along with this program.",
        ],
    ),
    "MPL-2.0": (
        ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL-2.0", "MPL-2.0 license", "MPL 2.0 license", "MPL 2.0"],
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    ),
    "EPL": (
        ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "Eclipse Public License, version 1.0", "Eclipse Public License", "EPL-2.0", "EPL-1.0", "EPL 2.0"],
        ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    ),
    "CDDL": (
        ["Common Development and Distribution License", "Common Development and Distribution License 1.0", "CDDL-1.0", "CDDL 1.1", "CDDL"],
        ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."],
    ),
    "EUPL": (
        ["European Union Public Licence", "European Union Public Licence 1.2", "EUPL-1.2", "EUPL v1.2", "EUPL"],
        ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."],
    ),
    "Artistic-2.0": (
        ["Artistic License 2.0", "Artistic License", "Artistic-2.0", "Perl Artistic License"],
        ["This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself, either the GNU General Public License or the Artistic License."],
    ),
    "Unlicense": (
        ["Unlicense", "The Unlicense", "Unlicense license"],
        [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        ],
    ),
    "WTFPL": (
        ["WTFPL", "WTFPL version 2", "Do What The Fuck You Want To Public License"],
        ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    ),
    "OFL-1.1": (
        ["SIL Open Font License, Version 1.1", "SIL Open Font License", "Open Font License", "OFL-1.1", "OFL"],
        ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at https://openfontlicense.org"],
    ),
    "CC-BY": (
        ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "CC BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution License", "Creative Commons Attribution 4.0"],
        ["You are free to share and adapt the material for any purpose, even commercially, under the Creative Commons Attribution license terms", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    ),
    "CC-BY-SA": (
        ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "CC-BY-SA-3.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike License", "Creative Commons ShareAlike"],
        ["If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons ShareAlike license as the original", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    ),
    "CC-BY-NC": (
        ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-SA-4.0", "CC BY-NC 3.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "Creative Commons NonCommercial license"],
        ["You may not use the material for commercial purposes under the Creative Commons NonCommercial license", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    ),
    "CC-BY-ND": (
        ["CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-ND", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives License"],
        ["If you remix, transform, or build upon the material, you may not distribute the modified material under the Creative Commons NoDerivatives license"],
    ),
    "CC0": (
        ["CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero license", "CC0-1.0", "CC0-1.0 license", "Creative Commons CC0 Public Domain Dedication"],
        ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"],
    ),
}
#: How notices are worded.
WORDINGS = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is licensed under the {}.", "This software is distributed under the terms of the {}.", "Distributed under the {}.", "Available under the {}.", "See LICENSE: {}.", "SPDX-License-Identifier: {}",
    "This program is free software, published under the {}.", "The code is covered by the {}.", "Content on this site is available under {} unless noted.", "License: {}", "{}",
]
#: Licences that are none of the families, and holders of licences.
OTHER_LICENCES = [
    "Acme Commercial License", "Foobar Public License, version 2.0", "Example Community License 1.0", "Proprietary License", "Enterprise License Agreement", "End User License Agreement", "Contoso Source License v3", "Server Side License 1.0", "Business Terms 2.0",
    "Oracle Binary Code License", "Elastic License 2.0", "Open Database License", "Company License version 3", "Developer Agreement 4.0", "software license agreement", "Common Public License 1.0", "Academic Free License v3.0", "Intel Open Source License", "Sun Public License", "Vendor EULA",
]
#: Sentences with the same words that are no licence notice.
OTHERS = [
    "The driver renewed his license at the county office.", "Her fishing license expired in May.", "A license plate was found near the road.", "The restaurant lost its liquor license.", "Permission was granted to enter the building.",
    "Copyright law changed in the nineteenth century.", "All rights reserved.", "Copyright 2019 by the author.", "Copyright (c) 2020 Example Corp.", "The public domain is discussed in chapter two.", "The software was free of charge for schools.",
    "Free software is a matter of liberty, not price.", "Version 2.0 of the product was released in June.", "Version 3 of the application was released today.", "The general public was invited to the meeting.", "Creative people share ideas in common rooms.", "The commons were open for grazing.",
    "The Apache helicopter was released from service.", "The Apache tribe lived in the southwest.", "Students at MIT built a robot.", "MIT students obtained a license.", "Researchers at MIT obtained a license to operate the reactor.", "MIT published a study of software.", "The GNU is a large antelope.", "A gnu ran across the plain.", "Mozilla released version 3 of its browser.", "BSD conferences are held every year.",
    "The license holder must attend the hearing.", "Attribution of the painting is uncertain.", "Commercial use of the harbour is growing.", "The foundation published its terms.", "This work is discussed under the same heading.",
    "Please see the terms and conditions of sale.", "Warranty claims are handled by the store.", "Licensed professionals only may enter.", "He was licensed to practise medicine.", "Source code in binary form was lost.",
    "The eclipse of the sun was visible from the island.", "The boost in sales was welcome.", "An artistic license was taken with the plot.", "The artist has artistic license.", "The European Union published a report.", "A font was chosen for the cover.", "The common development of the region and the distribution of food", "The library is free and open to the public.",
    "Without the express permission of the owner no one may enter.", "The warranties of the seller are limited.", "In no event shall the meeting be delayed.", "The author was liable for damages in contract.", "Goods are provided as is, without refund.", "The following conditions are met by all candidates.", "Any person may obtain a copy of the report.",
    "You may not use this entrance.", "You can obtain one at the office.", "Copies of the document are distributed to members.", "The program and the accompanying materials are in the folder.", "Please retain the above receipt.", "The names of its members may be used in print.", "The origin of the species must not be misrepresented.",
    "Subject to the following restrictions, visitors are welcome.", "The county will distribute the food for any purpose.", "The original software was sold in 1990.", "Everyone is permitted to enter.", "By any means, commercial or otherwise.", "The material is new.", "A later version of the story is told.", "Either version of the story may be true.",
    "The zero point of the scale.", "International attribution of the attack is hard.", "The cc field of the mail was empty.", "Send it by mail, cc the manager.", "He drove by at noon.", "The share of the market grew.", "Adapt the recipe for any purpose.", "Work is a creative act.", "The package is distributed in the hope of profit.",
    "Apache Kafka moves messages between services.", "An Apache warrior rode by.", "The Apache server was started.", "Mozilla and other browsers", "Er kam mit dem Zug und ging mit ihr nach Hause.", "Mit freundlichen Grüßen", "MIT DER ZEIT", "Kaffee mit Milch", "The sa and nd of the cc", "by nc or by nd", "Boost your sales by 3.0 percent.",
    "The use of this file requires a password.", "This file is part of the archive.", "Unless required by law, no notice is given.", "Limitations of the study are listed below.", "Permissions and limitations are explained in the manual.", "Your license has been revoked.", "Buy a license key now.", "A software license costs ten dollars.", "The licence fee was raised.",
]
#: Names that are words of a language, too, and say nothing alone.
NOT_ALONE = {"mit", "isc"}
#: Words that alone say nothing; no feature consists of them and of numbers only.
STOP = set(
    "a an and any are as at be been but by can do for from has have he her his if in into is it its may more most must no not of off on one or our out over own same she should so some such than that the their them then there these they this those to too under until up upon was we were what when where which who whom will with within without would you your all also each other only very just how i s t us me my him d ll m re ve e g n o p c b x v"
    .split()
)
